"""Line dedup over overlapping windows of three lines.

Native: DataFrame functions only. A window is three consecutive lines that hold more than white space (blank lines
between them are passed over); its hash is of the lines without white space at their ends. Windows that occur more than
once in the corpus are found by one aggregation, which keeps the place of the first, and joined back to their places;
every place but the first covers its three lines, coverings are merged, and covered lines are removed. Blank lines stay.

"First" is by doc_id, a number, null before all, then by line. Defined results. A doc_id that isn't a number of at most 28
digits fails. Null text stays null, and texts of fewer than
three such lines stay as they are. Rows that share a doc_id count as one document: a window at the same line of both is
one place. An empty table gives an empty result. Further columns are carried, but for ``n_removed_lines``, which is
replaced; names that begin with ``_ld_`` are the operator's. A text of which every line is covered becomes empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions.exprs import let
from gazette.llm.shared import cut

WINDOW = 3
BLANKS = " \t\r\f\v"
PLACE = "decimal(38,0)"


def _lines(text: str = "text") -> Column:
    return F.split(F.col(text), "\n")


def _document() -> Column:
    """doc_id as a number that orders null first."""
    return F.coalesce(F.col("doc_id").cast(PLACE), F.lit(-(1 << 63)).cast(PLACE))


def windows(docs: DataFrame) -> DataFrame:
    """(a, b, place, doc_id, row, covers): each window's hash, its place as one number, and the lines it covers."""
    stripped = F.transform(_lines(), lambda line, i: F.struct(i.alias("i"), F.btrim(line, F.lit(BLANKS)).alias("line")))
    full = docs.select("doc_id", F.xxhash64("text").alias("row"), F.filter(stripped, lambda x: x["line"] != "").alias("full")).where(F.size("full") >= WINDOW)
    hashed = full.select("doc_id", "row", F.transform("full", lambda x: F.struct(x["i"].alias("i"), F.xxhash64(x["line"]).alias("a"), F.xxhash64(F.lit(7919), x["line"]).alias("b"))).alias("h"))
    # bound once, so that a text's work is linear in its lines
    spans = let(F.col("h"), lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.slice(h, i, WINDOW)))
    each = hashed.select("doc_id", "row", F.explode(spans).alias("w"))
    place = (_document() * F.lit(1 << 32).cast("decimal(10,0)") + F.col("w")[0]["i"]).cast(PLACE)
    return each.select(F.xxhash64("w.a").alias("a"), F.xxhash64("w.b").alias("b"), place.alias("place"), "doc_id", "row", F.col("w.i").alias("covers"))


def repeated(each: DataFrame) -> DataFrame:
    """(a, b, first) of the windows at more than one place."""
    return each.groupBy("a", "b").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("last > first").select("a", "b", "first")


def covered(docs: DataFrame) -> DataFrame:
    """(doc_id, row, lines): the lines to be removed from each row that has any."""
    each = windows(docs)
    first = cut(repeated(each), "line-windows").select(F.col("a").alias("_a"), F.col("b").alias("_b"), "first")
    later = each.join(first, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).where("place > first")
    return later.groupBy("doc_id", "row").agg(F.array_distinct(F.flatten(F.collect_list("covers"))).alias("lines"))


def deduped(docs: DataFrame) -> DataFrame:
    """docs with text without the covered lines, and n_removed_lines."""
    cover = covered(docs.select("doc_id", "text")).select(F.col("doc_id").alias("_ld_id"), F.col("row").alias("_ld_row"), F.col("lines").alias("_ld_covered"))
    keyed = docs.withColumn("_ld_key", F.xxhash64("text"))
    joined = keyed.join(cover, F.col("doc_id").eqNullSafe(F.col("_ld_id")) & (F.col("_ld_key") == F.col("_ld_row")), "left")
    # by number, so that both steps are linear in the lines of a text
    kept = F.array_except(F.sequence(F.lit(0), F.size(_lines()) - 1), F.col("_ld_covered"))
    text = let(_lines(), lambda lines: F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    any_ = F.col("_ld_covered").isNotNull()
    out = joined.withColumns({"_ld_text": F.when(any_, text).otherwise(F.col("text")), "n_removed_lines": F.when(any_, F.size("_ld_covered")).otherwise(0).cast("long")})
    carried = [F.col("_ld_text").alias("text") if c == "text" else F.col(c) for c in docs.columns if c != "n_removed_lines"]
    return out.select(*carried, "n_removed_lines")
