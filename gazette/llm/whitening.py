"""Embedding whitening with distributed block matrices.

Vectors become whole numbers, floor(256 c). The fit list holds each distinct vector once. Its centred rows are indexed
and cut into blocks of MLlib's BlockMatrix; its transpose times itself, summed over slices of the rows, is the scatter, a
matrix of dimension by dimension. That alone comes to the driver, for its eigenvectors. A second multiplication, of the
blocks by the whitening matrix, gives the coordinates, which are joined back to all rows that have the vector.

Defined results. Vectors that are null, or hold null or non-finite entries, are left out; so are empty ones. Vectors of
different lengths are whitened apart, each length over its own. Repeated rows, also of one or a null vec_id, each have
their coordinates. Directions without variance have none: a component is given only if its eigenvalue is above rounding,
so a single vector has no row. Entries beyond the range of a long are its ends. A deviation beyond that range is null.
Eigenvectors' largest entry is positive. An empty table gives an empty result. Further columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from gazette.llm.shared import cut, cuts, remove

SCALE, COMPONENTS = 256, 4
#: Numbers of a block: 2 MB. Its rows follow from the dimension.
BLOCK_NUMBERS = 1 << 18
#: A block as MLlib takes it: its place, and a matrix, which tables hold as a plain struct.
BLOCK = StructType([StructField("place", StructType([StructField("row", LongType()), StructField("column", LongType())])), StructField("matrix", MatrixUDT())])
#: And as it gives it.
PRODUCT = StructType([StructField("place", StructType([StructField("_1", IntegerType()), StructField("_2", IntegerType())])), StructField("matrix", MatrixUDT.sqlType())])
#: The largest number whose square is a long.
ROOT = 3_037_000_499


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): floor(scale * c) of the rows that take part."""
    fit = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (F.size("embedding") > 0)
    return vectors.where(F.coalesce(fit, F.lit(False))).select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * scale)).alias("x"))


@dataclass
class Fit:
    """n distinct vectors of one length, their sums, and the components: eigenvalues, their share of the trace, and unit eigenvectors as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    explained: np.ndarray
    vectors: np.ndarray


def indexed(rows: DataFrame) -> DataFrame:
    """rows, a written table, with index from 0 without gaps: place within a file's task, and the counts before it."""
    placed = cut(rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "whitening-placed")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_rows"))  # a row for each task
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(counts.select(F.col("_part").alias("_p"), before.alias("_before")), F.col("_part") == F.col("_p")).select(*rows.columns, (F.col("_at") + F.col("_before")).alias("index"))


def _blocks(rows: DataFrame, column: str, rows_per_block: int, dim: int) -> BlockMatrix:
    """index and an array of doubles as a block matrix: a block's rows are gathered, at most rows_per_block, and written as a matrix by rows; no row passes Python."""
    at = F.struct(F.pmod("index", F.lit(rows_per_block)).alias("at"), F.col(column).alias("v"))
    packed = rows.groupBy(F.expr(f"index div {rows_per_block}").alias("row")).agg(F.array_sort(F.collect_list(at)).alias("rows"))
    values = F.flatten(F.transform("rows", lambda r: r["v"]))
    none = F.lit(None).cast("array<int>")
    matrix = F.struct(F.lit(1).cast("tinyint").alias("type"), F.size("rows").alias("numRows"), F.lit(dim).alias("numCols"), none.alias("colPtrs"), none.alias("rowIndices"), values.alias("values"), F.lit(True).alias("isTransposed"))
    blocks = cut(packed.select(F.struct("row", F.lit(0).cast("long").alias("column")).alias("place"), matrix.alias("matrix")), "whitening-blocks", BLOCK)
    return BlockMatrix(callMLlibFunc("createBlockMatrix", blocks, rows_per_block, dim, 0, 0), rows_per_block, dim)


def _rows(product: BlockMatrix, rows_per_block: int) -> DataFrame:
    """(index, w) of a block matrix of one column of blocks."""
    blocks = cut(callMLlibFunc("getMatrixBlocks", product._java_matrix_wrapper._java_model).toDF("place", "matrix"), "whitening-product", PRODUCT)
    m, width = (lambda f: F.col(f"matrix.{f}")), F.col("matrix.numCols")
    entry = lambda i, j: F.when(m("isTransposed"), F.get(m("values"), i * width + j)).otherwise(F.get(m("values"), i + j * m("numRows")))
    row = lambda i: F.struct((F.col("place._1").cast("long") * rows_per_block + i).alias("index"), F.transform(F.sequence(F.lit(0), width - 1), lambda j: entry(i, j)).alias("w"))
    return blocks.select(F.explode(F.transform(F.sequence(F.lit(0), m("numRows") - 1), row)).alias("r")).select("r.*")


def _scatter(blocks: BlockMatrix, slices: int) -> np.ndarray:
    """The transpose of blocks times blocks. Its rows are cut into slices, each summed in a task of its own, so none gets all blocks."""
    product = blocks.transpose()._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, slices)
    return BlockMatrix(product, blocks.colsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def fitted(distinct: DataFrame, dim: int, slices: int, rows_per_block: int, components: int = COMPONENTS) -> tuple[Fit, DataFrame, BlockMatrix] | None:
    """The fit over distinct(x), a written table of vectors of one length, with (index, x, deviation) and the centred blocks."""
    top = distinct.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("x", lambda v: F.abs(v.cast("decimal(20,0)"))))).alias("most")).first()
    n, most = top["n"], int(top["most"])
    narrow = dim * (2 * n * most) ** 2 < 1 << 63  # then longs hold every step
    number = "long" if narrow else "decimal(38,0)"
    sums = distinct.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.sum(F.col("v").cast(number)).alias("s")).collect()  # a row for each dimension
    by_dim = {r["d"]: int(r["s"]) for r in sums}
    total = [by_dim[d] for d in range(dim)]
    wide = F.lit(n).cast(number)
    sums_column = F.array(*[F.lit(s).cast(number) for s in total])
    moved = F.zip_with("x", sums_column, lambda v, s: (v.cast(number) * wide).cast(number) - s)
    rows = indexed(distinct).withColumn("moved", moved)
    squares = F.aggregate("moved", F.lit(0).cast(number), lambda a, v: (a + (v * v).cast(number)).cast(number))
    if not narrow:  # one square beyond a long makes the sum so
        squares = F.when(~F.exists("moved", lambda v: F.abs(v) > ROOT), squares)
    rows = cut(rows.select("index", "x", squares.try_cast("long").alias("deviation"), F.transform("moved", lambda v: v.cast("double") / F.lit(float(n))).alias("centred")), "whitening-centred")
    blocks = _blocks(rows, "centred", rows_per_block, dim)
    values, vectors = np.linalg.eigh(_scatter(blocks, slices) / n)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    trace = float(values.sum())
    sound = int((values > max(values[0], 0) * dim * np.finfo(float).eps).sum())
    used = min(components, sound)
    if not used:
        return None
    vectors = vectors[:, :used]
    signs = np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(used)])
    return Fit(n, total, values[:used], values[:used] / trace, vectors * signs), rows, blocks


def _whitened(rows: DataFrame, dim: int, components: int) -> DataFrame | None:
    spark = rows.sparkSession
    slices = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    distinct = cut(rows.where(F.size("x") == dim).select("x").distinct(), "whitening-distinct")
    rows_per_block = max(1, BLOCK_NUMBERS // dim)
    made = fitted(distinct, dim, slices, rows_per_block, components)
    if made is None:
        return None
    fit, listed, blocks = made
    used = len(fit.values)
    w = fit.vectors / np.sqrt(fit.values)
    whitening = BlockMatrix(spark.sparkContext.parallelize([((0, 0), Matrices.dense(dim, used, w.ravel(order="F").tolist()))], 1), dim, used)
    projected = _rows(blocks.multiply(whitening), rows_per_block)
    means = projected.agg(*[F.avg(F.col("w")[i]).alias(f"m{i}") for i in range(used)]).first()
    pairs = [(i, j) for i in range(used) for j in range(i, used)]
    moments = projected.agg(*[F.avg((F.col("w")[i] - means[i]) * (F.col("w")[j] - means[j])).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(moments[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    known = listed.select("index", F.col("x").alias("_x"), "deviation").join(projected, "index").select("_x", "deviation", "w")
    joined = rows.where(F.size("x") == dim).join(known, F.col("x") == F.col("_x"))
    each = joined.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    explained = F.element_at(F.array(*[F.lit(float(e)) for e in fit.explained]), F.col("at") + 1)
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(float(error)).alias("identity_error"))


def whitened(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every row of vectors(vec_id, embedding) that takes part and the first components."""
    spark = vectors.sparkSession
    outside = cuts(spark)
    rows = cut(whole_numbers(vectors, scale), "whitening-rows")
    lengths = sorted(r[0] for r in rows.select(F.size("x")).distinct().collect())  # the lengths that vectors have
    out = [x for x in (_whitened(rows, d, components) for d in lengths) if x is not None]
    if not out:
        empty = rows.where("false").select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))])
        remove(spark, [p for p in cuts(spark) if p not in outside][1:])
        return empty
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    every = cut(every, "whitening-result")
    remove(spark, [p for p in cuts(spark)[:-1] if p not in outside])
    return every
