"""Exact top-k search by tiled matrix products.

Vectors become integer rows; rows are packed into blocks of at most ``TILE`` as one binary matrix. Query blocks and
candidate blocks meet by a join on their cell of a grid: candidate blocks keep to their shard, query blocks are sent to
every shard. A query block meets all candidate blocks of a shard one after the other; a task multiplies one pair at a time,
selects the k best of each query in the tile, merges them into the query block's running list, and gives that list once,
so a shard makes k rows a query however many blocks it has, and memory is that of two blocks. The shards' lists are then
merged up a tree, ``FAN`` lists to one at a time.

Defined results. Vectors that are null, or hold null or non-finite components, take no part, nor do rows with a null
vec_id; vectors of different lengths aren't compared. Repeated vec_ids are separate candidates with equal ids, and separate
queries, each with its own k rows; a query meets no row with its own vec_id. Ties go to the smaller vec_id. Fewer
candidates than k: all. Components and scores beyond the range of a long are its ends. Empty tables give an empty result.
Further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm.shared import cut, cuts, remove

TILE, FAN, SCALE = 512, 16, 256


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, of the rows that take part."""
    fit = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(fit, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def blocks(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """(block, dim, ids, m): rows packed in blocks within each partition; m holds their components as little-endian int64."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        made = 0

        def flush(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, parts = held.pop(dim)
            made += 1
            return pa.RecordBatch.from_pylist([{"block": made, "dim": dim, "ids": ids, "m": np.array(parts, "<i8").tobytes()}], schema=pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("ids", pa.list_(pa.int64())), ("m", pa.binary())]))

        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v"), strict=True):
                x = v.values.to_numpy()
                ids, parts = held.setdefault(len(x), ([], []))
                ids.append(i)
                parts.append(x)
                if len(ids) >= tile:
                    yield flush(len(x))
        for dim in list(held):
            yield flush(dim)

    packed = rows.mapInArrow(pack, "block long, dim int, ids array<long>, m binary")
    return packed.withColumn("block", F.shiftleft(F.spark_partition_id().cast("long"), 32) + F.col("block"))


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    most = max(1, q.shape[1]) * max(-int(q.min(initial=0)), int(q.max(initial=0))) * max(-int(c.min(initial=0)), int(c.max(initial=0)))
    if most < 1 << 53:
        return (q.astype(float) @ c.T.astype(float)).astype(np.int64)
    if most < 1 << 63:
        return q @ c.T
    ends = np.iinfo(np.int64)  # in integers of any size
    return np.clip(q.astype(object) @ c.T.astype(object), ends.min, ends.max).astype(np.int64)


def _first(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, by score, then id."""
    order = np.lexsort((ids, ~scores, rows))  # ~ turns the order of all longs around
    rows, ids, scores = rows[order], ids[order], scores[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], ids[keep], scores[keep]


def products(pairs: DataFrame, k: int) -> DataFrame:
    """(query_row, query_id, list, vec_id, score): the k best of each row of a query block over the candidate blocks that follow each other with it; list is the pairs' shard."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        at, q_ids, q = None, None, None

        def flush() -> pa.RecordBatch:
            rows, ids, scores = held
            return pa.RecordBatch.from_arrays([pa.array((at[1] << 20) + rows), pa.array(q_ids[rows]), pa.array(np.full(len(rows), at[0])), pa.array(ids), pa.array(scores)], names=["query_row", "query_id", "list", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                now = batch.column("shard")[i].as_py(), batch.column("q_block")[i].as_py()
                matrix = lambda n, ids, i=i, batch=batch: np.frombuffer(batch.column(n)[i].as_buffer(), "<i8").reshape(len(ids), -1)
                if now != at:
                    if at:
                        yield flush()
                    at, held = now, tuple(x[:0] for x in held)
                    q_ids = batch.column("q_ids")[i].values.to_numpy().copy()
                    q = matrix("q_m", q_ids).copy()
                c_ids = batch.column("c_ids")[i].values.to_numpy()
                scores = _scores(q, matrix("c_m", c_ids))
                own = q_ids[:, None] == c_ids[None, :]
                scores[own] = np.iinfo(np.int64).min
                if len(c_ids) > k:  # all that reach the k-th best score
                    kth = np.partition(scores, len(c_ids) - k, axis=1)[:, len(c_ids) - k]
                    rows, place = np.nonzero((scores >= kth[:, None]) & ~own)
                else:
                    rows, place = np.nonzero(~own)
                tile = _first(rows, c_ids[place], scores[rows, place], k)
                held = _first(*[np.concatenate(x) for x in zip(held, tile, strict=True)], k)
        if at:
            yield flush()

    return pairs.mapInArrow(multiply, "query_row long, query_id long, list long, vec_id long, score long")


def best(lists: DataFrame, k: int, *keys: str) -> DataFrame:
    ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, tile: int = TILE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of vectors(vec_id, embedding) for each row of queries(vec_id, embedding)."""
    spark = vectors.sparkSession
    outside = cuts(spark)
    candidates = cut(blocks(quantized(vectors), tile), "topk-candidates").selectExpr("block as c_block", "dim", "ids as c_ids", "m as c_m")
    few = max(1, -(-queries.count() // tile))
    asked = cut(blocks(quantized(queries).repartition(few), tile), "topk-queries").selectExpr("block as q_block", "dim as q_dim", "ids as q_ids", "m as q_m")
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    c = candidates.withColumn("shard", F.pmod(F.xxhash64("c_block"), F.lit(shards)))
    q = asked.withColumn("q_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("q_shard", F.col("q_shard").cast("long"))
    # by merge, the queries first: such a join gives all candidates of a shard for a query block before it goes on to the next
    pairs = q.join(c.hint("merge"), (F.col("q_shard") == F.col("shard")) & (F.col("q_dim") == F.col("dim"))).select("shard", "q_block", "q_ids", "q_m", "c_ids", "c_m")
    lists = cut(products(pairs, k), "topk-lists")
    n = shards
    while n > FAN:
        n = -(-n // FAN)
        lists = best(lists.withColumn("list", F.col("list") % n), k, "query_row", "list").drop("rank")
    out = cut(best(lists, k, "query_row").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "topk-result")
    remove(spark, [p for p in cuts(spark)[:-1] if p not in outside])
    return out
