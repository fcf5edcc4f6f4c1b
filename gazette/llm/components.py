"""Connected components by the least label, with pointer jumping, over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.shared import cut, cuts, remove


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(u, v); root is the least node of its component.

    Each round takes the least label among the neighbours, then the label's label, so rounds grow with the logarithm of
    the longest path. Labels are joined from written tables, so a node with very many edges is split like any skewed key.
    """
    both = cut(edges.select("u", "v").unionByName(edges.selectExpr("v as u", "u as v")).where("u <> v").distinct(), "component-edges")
    spark = edges.sparkSession
    outside = cuts(spark)
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("near")).select("node", F.least("node", "near").alias("root")), "component-labels")
    while True:
        stale = [p for p in cuts(spark) if p not in outside]
        heads = labels.select(F.col("node").alias("_u"), F.col("root").alias("_root"))
        seen = both.join(heads, F.col("u") == F.col("_u")).groupBy(F.col("v").alias("node")).agg(F.min("_root").alias("near"))
        nearer = cut(labels.join(seen, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root")), "component-nearer")
        jump = nearer.select(F.col("node").alias("_n"), F.col("root").alias("_next"))
        labels = cut(nearer.join(jump, F.col("root") == F.col("_n")).select("node", "was", F.least("root", "_next").alias("root")), "component-labels")
        settled = labels.where("was <> root").limit(1).count() == 0
        remove(spark, stale)  # the new labels hold all that the last round's did
        labels = labels.select("node", "root")
        if settled:
            return labels
