"""Best-fit packing by exact-complement hashing.

Pieces of at most ``capacity`` tokens go into sequences of that size. The plan needs only the number of pieces of each
length, at most ``capacity`` counts whatever the corpus, so it is made on the driver: for each length, longest first,
the gap it leaves is looked up among the sums of one, two and three available lengths, and combinations that fill it
exactly are consumed as often as their counts allow. What is left is packed best-fit, and each gap on the way is
looked up again. Pieces are then dealt to the plan's places by their rank within their length; ranks come from
counts of (length, bucket), so a length that a third of all pieces share is spread over the buckets.

Defined results. Null text: as an empty one, a piece with the end id alone. Repeated rows: each is packed. Null ids
are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm.shared import cut, give_back_memory
from gazette.llm.tokens import encoder, with_end

CAPACITY, END_ID = 4096, 1
#: Pieces of one (length, bucket) that one task ranks, about, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 1_000_000, 128


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) per piece. Documents of more than capacity ids are cut there."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary)
        for batch in batches:
            done = 0
            for ids, ends in tokens.encode(batch.column("text")):
                ids, ends = with_end(ids, ends, end_id)
                begins = np.append(0, ends[:-1])
                n = -(-(ends - begins) // capacity)
                row = np.repeat(np.arange(len(ends)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, (ends - begins)[row] - start)
                raw = memoryview(ids.astype("<u4", copy=False).view(np.uint8))
                parts = [raw[4 * b : 4 * (b + x)] for b, x in zip((begins[row] + start).tolist(), length.tolist(), strict=True)]
                columns = [batch.column("doc_id").slice(done, len(ends)).take(pa.array(row)), piece, start, length, [zlib.crc32(x) for x in parts], *([[bytes(x) for x in parts]] if with_ids else [])]
                done += len(ends)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))
        give_back_memory()

    kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.binary()} if with_ids else {})
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut_up, schema)


class _Sums:
    """An index of the sums of one, two and three available lengths.

    Availability only falls between two calls of index(), which is called where no length is held back. So a sum that
    the index lacks doesn't exist, and one that it has is looked for among the counts as they are now.
    """

    MISSES = 64

    def __init__(self, left: np.ndarray):
        self.left = left
        self.index()

    def index(self) -> None:
        there = self.left > 0
        self.pairs, self.triples = np.zeros(len(there), bool), np.zeros(len(there), bool)
        for a in np.flatnonzero(there):
            self.pairs[a:] |= there[: len(there) - a]
        for a in np.flatnonzero(there):
            self.triples[a:] |= self.pairs[: len(there) - a]
        self.misses = 0

    def refresh(self) -> None:
        """Between two sequences: index anew after many sums that turned out to be gone."""
        if self.misses > self.MISSES:
            self.index()

    def one(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.left[gap] > 0 else None

    def two(self, gap: int) -> tuple[int, ...] | None:
        """With the longest first."""
        if not self.pairs[gap]:
            return None
        half = (gap + 1) // 2
        a = np.flatnonzero((self.left[half:gap] > 0) & (self.left[gap - half : 0 : -1] > 0))
        for x in a[::-1][:2]:  # only two equal lengths can lack a second piece
            pair = (half + int(x), gap - half - int(x))
            if pair[0] != pair[1] or self.left[pair[0]] > 1:
                return pair
        self.misses += 1
        return None

    def three(self, gap: int) -> tuple[int, ...] | None:
        if not self.triples[gap]:
            return None
        for a in np.flatnonzero((self.left[1 : gap - 1] > 0) & self.pairs[gap - 1 : 1 : -1])[::-1] + 1:
            self.left[a] -= 1
            pair = self.two(gap - int(a))
            self.left[a] += 1
            if pair:
                return (int(a), *pair)
        self.misses += 1
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        if gap <= 0:
            return () if gap == 0 else None
        return self.one(gap) or self.two(gap) or self.three(gap)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """[(lengths of a sequence with their numbers, how many such sequences)] for counts of lengths."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[dict[int, int], int]] = []

    def consume(lengths: list[int]) -> None:
        pattern = Counter(lengths)
        times = min(int(left[x]) // n for x, n in pattern.items())
        for x, n in pattern.items():
            left[x] -= times * n
        out.append((dict(pattern), times))

    sums = _Sums(left)
    for length in range(capacity, 0, -1):  # exact combinations first
        while left[length] > 0:
            sums.refresh()
            left[length] -= 1
            rest = sums.exact(capacity - length)
            left[length] += 1
            if rest is None:
                break
            consume([length, *rest])
    while (there := np.flatnonzero(left)).size:  # then the longest that fits, and each gap looked up again
        sums.refresh()
        chosen = [int(there[-1])]
        gap = capacity - chosen[0]
        left[chosen[0]] -= 1
        while gap > 0:
            rest = sums.exact(gap)
            if rest is None:
                fit = np.flatnonzero(left[: gap + 1])
                if not fit.size:
                    break
                rest, gap = (int(fit[-1]),), gap - int(fit[-1])
            else:
                gap = 0
            chosen += rest
            for x in rest:
                left[x] -= 1
        for x in chosen:
            left[x] += 1
        consume(chosen)
    return out


class Places:
    """Where the r-th piece of a length goes: sorted segments per length."""

    def __init__(self, patterns: list[tuple[dict[int, int], int]], capacity: int = CAPACITY):
        rows, sequence, used = [], 0, np.zeros(capacity + 1, np.int64)
        for pattern, times in patterns:
            offset = 0
            for length, n in sorted(pattern.items(), reverse=True):
                rows.append((length, used[length], n, sequence, offset))
                used[length] += n * times
                offset += n * length
            sequence += times
        self.sequences = sequence
        self.length, self.rank, self.n, self.first, self.offset = np.array(sorted(rows), np.int64).reshape(-1, 5).T
        self.begin = np.searchsorted(self.length, np.arange(capacity + 2))

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence_id, offset) arrays."""
        segment = np.empty(len(lengths), np.int64)
        for length in np.unique(lengths):
            here = lengths == length
            b, e = self.begin[length], self.begin[length + 1]
            segment[here] = b + np.searchsorted(self.rank[b:e], ranks[here], "right") - 1
        within = ranks - self.rank[segment]
        return self.first[segment] + within // self.n[segment], self.offset[segment] + within % self.n[segment] * lengths


def packed(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts(doc_id, piece, length, ids_crc32, ...), each length from 1 to capacity, with sequence_id and offset. parts is read three times: a written table."""
    total = parts.count()
    buckets = max(LEAST_BUCKETS, total // BUCKET_ROWS)
    dealt = parts.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.input_file_name()), F.lit(buckets)))
    counts = cut(dealt.groupBy("length", "_bucket").agg(F.count("*").alias("n")), "packing-counts")
    # at most capacity rows
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(plan(lengths, capacity), capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select(F.col("length").alias("_l"), F.col("_bucket").alias("_b"), F.coalesce(before, F.lit(0)).alias("_first"))
    nth = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = dealt.withColumn("_nth", nth).join(firsts, (F.col("length") == F.col("_l")) & (F.col("_bucket") == F.col("_b")))
    schema = parts.schema.simpleString()[len("struct<") : -1] + ",sequence_id:bigint,offset:bigint"
    names = parts.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.of(batch.column("length").to_numpy(), batch.column("_first").to_numpy() + batch.column("_nth").to_numpy() - 1)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "_first", "_nth").mapInArrow(place, schema)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row per piece of docs(doc_id, text), with its place."""
    return packed(cut(pieces(docs, vocabulary, capacity, end_id, with_ids), "packing-pieces"), capacity)


def sequences(places: DataFrame) -> DataFrame:
    """sequence_id, ids: the sequences themselves, from pack(..., with_ids=True). A group holds at most capacity ids."""
    grouped = places.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return grouped.select("sequence_id", F.expr("aggregate(transform(parts, p -> p.ids), cast('' as binary), (a, b) -> concat(a, b))").alias("ids"))
