"""Numbers and pages of a sorted table, by range partitions and the counts before them, without a sort of the whole in one task."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.session import scratch, written


def numbered(rows: DataFrame, by: list[Column], group: str | None = None) -> DataFrame:
    """rows with number, from 0 in each group (or in all) by the order. by is a total order; where it repeats, equal rows stand in any order."""
    spark = rows.sparkSession
    order = [*([F.col(group).asc_nulls_first()] if group else []), *by]
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed = written(placed.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    keys = [group] if group else []
    runs = placed.groupBy(*keys, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # a row for each group and for each range
    before = F.sum("_n").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_r"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return placed.join(runs, same).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("number"))


@dataclass
class Pages:
    """E1 for deep pages: rows by ranges of their order, a folder each, and how many rows stand before each range. A page reads and sorts the ranges that it falls into, one or two however deep it is."""

    rows: DataFrame
    by: list[Column]
    before: list[tuple[int, int]]
    total: int

    @classmethod
    def of(cls, rows: DataFrame, by: list[Column], ranges: int | None = None) -> Pages:
        """by is a total order, so that a page is the same whenever it is asked for."""
        spark = rows.sparkSession
        ranges = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        path = f"{scratch(spark)}/pages-{uuid.uuid4().hex}"
        rows.repartitionByRange(ranges, *by).withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(path)
        placed = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, _range int").parquet(path)
        before, total = [], 0
        for r in placed.groupBy("_range").count().orderBy("_range").collect():  # a row for each range
            before.append((r["_range"], total))
            total += r["count"]
        return cls(placed, by, before, total)

    def page(self, page: int = 1, limit: int = 12) -> DataFrame:
        """The rows of a page with page, total, total_pages, has_next and has_prev, as listing.page_of() gives them."""
        page, limit = max(page, 1), min(max(limit, 1), 50)
        start = (page - 1) * limit
        ends = [*[b for _, b in self.before[1:]], self.total][: len(self.before)]
        touched = [(r, b) for (r, b), e in zip(self.before, ends, strict=True) if b < start + limit and e > start]
        first = touched[0][1] if touched else 0
        rows = self.rows.where(F.col("_range").isin([r for r, _ in touched])).drop("_range").orderBy(*self.by).offset(start - first).limit(limit) if touched else self.rows.drop("_range").limit(0)
        pages = -(-self.total // limit)
        facts = {"total": self.total, "page": page, "total_pages": pages, "has_next": page < pages, "has_prev": page > 1}
        return rows.withColumns({c: F.lit(x).cast("long") if c in ("total", "total_pages") else F.lit(x) for c, x in facts.items()})
