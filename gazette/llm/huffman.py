"""Token ids as files: canonical length-limited Huffman codes, in independent blocks with bit-offset checkpoints.

Codes come from the counts of ids over the whole corpus (at most one count per vocabulary entry). Their lengths are
the optimal ones under a limit, by package-merge; the canonical codes follow from the lengths alone, which are stored
beside the blocks. A block holds whole documents in ascending doc_id order and is decoded by itself: a table indexed by
the next ``LIMIT`` bits gives id and length, and all segments between checkpoints advance together.

Defined results. Null text: as an empty one, the end id alone. Rows with equal doc_id stand together, in any order among
themselves; null doc_ids come first. An empty table gives empty files. A document longer than a block makes a block by
itself. Further columns don't matter. More than 65,536 different ids have no codes of 16 bits, so a corpus that uses more
of a larger vocabulary raises ValueError.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.dart_minhash import mix
from gazette.llm.shared import cut, cuts, give_back_memory, remove
from gazette.llm.tokens import encoder, with_end

END_ID = 2
#: Longest code in bits, most ids and documents of a block, ids between checkpoints.
LIMIT, BLOCK_IDS, BLOCK_DOCS, CHECK_IDS = 16, 1 << 16, 1 << 12, 256
#: Ids that are decoded together, for a bound on memory.
DECODE_IDS = 1 << 22


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Length of each symbol's code, 0 where the count is 0, by package-merge."""
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order]
    levels, items = [], leaves
    is_leaf = np.ones(len(leaves), bool)
    for _ in range(limit):
        levels.append(is_leaf)
        packages = items[0 : len(items) // 2 * 2 : 2] + items[1::2]
        both = np.concatenate([leaves, packages])
        by_weight = np.argsort(both, kind="stable")
        items, is_leaf = both[by_weight], by_weight < len(leaves)
    taken = 2 * len(leaves) - 2
    lengths = np.zeros(len(leaves), np.uint8)
    for is_leaf in reversed(levels):
        singles = int(is_leaf[:taken].sum())
        lengths[:singles] += 1
        taken = 2 * (taken - singles)
    out[order] = lengths
    return out


@dataclass
class Code:
    """Canonical codes from lengths: by length, then by symbol."""

    lengths: np.ndarray

    def __post_init__(self):
        used = np.flatnonzero(self.lengths)
        order = used[np.argsort(self.lengths[used], kind="stable")]
        size = 1 << LIMIT
        steps = size >> self.lengths[order].astype(np.int64)
        ends = np.cumsum(steps)
        self.codes = np.zeros(len(self.lengths), np.uint64)
        self.codes[order] = ((ends - steps) >> (LIMIT - self.lengths[order].astype(np.int64))).astype(np.uint64)
        self.symbol_at = np.zeros(size, np.uint32)
        self.length_at = np.ones(size, np.int64)
        filled = int(ends[-1]) if len(order) else 0
        self.symbol_at[:filled] = np.repeat(order, steps)
        self.length_at[:filled] = np.repeat(self.lengths[order], steps)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(payload, bit offsets of every CHECK_IDS-th id)."""
        if not len(ids):
            return b"", np.zeros(0, np.int64)
        n = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(n)
        starts = ends - n
        word, room = starts >> 6, 64 - (starts & 63) - n
        codes = self.codes[ids]
        over = np.flatnonzero(room < 0)
        parts = codes << np.maximum(room, 0).astype(np.uint64)
        parts[over] = codes[over] >> (-room[over]).astype(np.uint64)
        words = np.zeros(int(ends[-1] + 63 >> 6), np.uint64)
        first = np.searchsorted(word, np.arange(int(word[-1]) + 1))  # a code starts in every word but perhaps the last
        words[: len(first)] = np.bitwise_or.reduceat(parts, first)
        words[word[over] + 1] |= codes[over] << (64 + room[over]).astype(np.uint64)
        return words.astype(">u8").tobytes()[: int(ends[-1] + 7 >> 3)], starts[::CHECK_IDS]

    def decode(self, payloads: list[bytes], offsets: list[np.ndarray], sizes: np.ndarray) -> list[np.ndarray]:
        """Ids of each block, all their segments side by side."""
        raw = np.frombuffer(b"".join(payloads) + bytes(4), np.uint8).astype(np.uint32)
        ahead = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
        base = np.cumsum([0, *map(len, payloads)])
        position = np.concatenate([o + 8 * b for o, b in zip(offsets, base[:-1], strict=True)] or [np.zeros(0, np.int64)]).astype(np.int64)
        left = np.concatenate([np.append(np.full(len(o) - 1, CHECK_IDS), s - CHECK_IDS * (len(o) - 1)) if len(o) else np.zeros(0, np.int64) for o, s in zip(offsets, sizes, strict=True)] or [np.zeros(0, np.int64)])
        out = np.zeros((len(position), CHECK_IDS), np.uint32)
        for step in range(int(left.max()) if len(left) else 0):
            bits = ahead[position >> 3] >> (8 - (position & 7)).astype(np.uint32) & 0xFFFF
            out[:, step] = self.symbol_at[bits]
            position += np.where(left > step + 1, self.length_at[bits], 0)
        flat = out[np.arange(CHECK_IDS) < left[:, None]]
        return np.split(flat, np.cumsum(sizes)[:-1])


def tokenized(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian; 16 bits where the vocabulary allows, else 32), salt (any number)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary)
        kind = id_kind(tokens.size, end_id)
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            done = 0
            for ids, ends in tokens.encode(batch.column("text")):
                ids, ends = with_end(ids, ends, end_id)
                offsets = np.append(0, ends) * np.dtype(kind).itemsize
                raw = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids.astype(kind))]).cast(pa.binary())
                salt = mix((np.arange(len(ends)) + place).astype(np.uint64)).view(np.int64)
                place += len(ends)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(done, len(ends)), pa.array(np.diff(ends, prepend=0)), raw, pa.array(salt)], names=["doc_id", "n_tokens", "ids", "salt"])
                done += len(ends)
        give_back_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, n_tokens long, ids binary, salt long")


def id_kind(vocabulary_size: int, end_id: int) -> str:
    return "<u2" if max(vocabulary_size, end_id + 1) <= 1 << 16 else "<u4"


def counted(tokens: DataFrame, kind: str) -> np.ndarray:
    """Count of each id: summed in each task, then by id. The result has one row per vocabulary entry at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                n = np.bincount(np.frombuffer(ids.as_buffer(), kind))
                if len(n) > len(total):
                    total = np.append(total, np.zeros(len(n) - len(total), np.int64))
                total[: len(n)] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, np.int64)
    out[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


@dataclass
class Files:
    """A written corpus. blocks: (part, block, first, doc_ids, sizes, offsets, payload); codebook: (id, length)."""

    blocks: DataFrame
    codebook: DataFrame


def write(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> Files:
    """Encode docs(doc_id, text) and write the files to the shared folder."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    outside = cuts(spark)
    kind = id_kind(Tokenizer.from_file(vocabulary).get_vocab_size(), end_id)
    tokens = cut(tokenized(docs, vocabulary, end_id), "huffman-tokens")
    lengths = code_lengths(counted(tokens, kind))
    code = Code(lengths)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids, sizes, ids, held, block, first = [], [], [], 0, 0, 0

        part = 0

        def flush() -> pa.RecordBatch:
            nonlocal doc_ids, sizes, ids, held, block, first
            payload, offsets = code.encode(np.concatenate(ids))
            row = {"part": part, "block": block, "first": first, "doc_ids": doc_ids, "sizes": sizes, "offsets": offsets.tolist(), "payload": payload}
            block, first = block + 1, first + held
            doc_ids, sizes, ids, held = [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=BLOCK)

        for batch in batches:
            for part, doc_id, x in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                if held and held + len(x.as_buffer()) // np.dtype(kind).itemsize > BLOCK_IDS:
                    yield flush()
                doc_ids.append(doc_id)
                ids.append(np.frombuffer(x.as_buffer(), kind))
                sizes.append(len(ids[-1]))
                held += sizes[-1]
                if held >= BLOCK_IDS or len(sizes) >= BLOCK_DOCS:
                    yield flush()
        if doc_ids:
            yield flush()

    # ascending ranges of doc_id, each sorted; the number of a range is its rows' part. The salt, which is written, splits the rows of one doc_id
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = tokens.select("doc_id", "salt", "ids").repartitionByRange(parts, "doc_id", "salt").sortWithinPartitions("doc_id", "salt").select("doc_id", "ids", F.spark_partition_id().alias("part"))
    blocks = ordered.mapInArrow(encode, "part int, block int, first long, doc_ids array<long>, sizes array<long>, offsets array<long>, payload binary")
    used = np.flatnonzero(lengths)
    codebook = spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, length int")
    files = Files(cut(blocks, "huffman-blocks"), cut(codebook.coalesce(1), "huffman-codebook"))
    remove(spark, [p for p in cuts(spark)[:-2] if p not in outside])  # the tokens
    return files


BLOCK = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary())])


def read(files: Files, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids as little-endian unsigned 32-bit integers) of every document, decoded."""
    book = files.codebook.toPandas()  # a row per vocabulary entry at most
    lengths = np.zeros(int(book["id"].max()) + 1 if len(book) else 0, np.uint8)
    lengths[book["id"].to_numpy(np.int64)] = book["length"].to_numpy(np.uint8)
    code = Code(lengths)
    # ids in each range: as many rows as there are ranges
    sums = files.blocks.groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n")).orderBy("part").collect()
    before, total = {}, 0
    for r in sums:
        before[r["part"]] = total
        total += r["n"]

    def documents(rows: list[dict]) -> pa.RecordBatch:
        totals = np.array([sum(r["sizes"]) for r in rows], np.int64)
        out = []
        for r, ids in zip(rows, code.decode([r["payload"] for r in rows], [np.array(r["offsets"], np.int64) for r in rows], totals), strict=True):
            at = 0
            for doc_id, n in zip(r["doc_ids"], r["sizes"], strict=True):
                one = ids[at : at + n].astype("<u4").tobytes()
                out.append((doc_id, before[r["part"]] + r["first"] + at, n, zlib.crc32(one), one))
                at += n
        columns = list(zip(*out, strict=True))[: len(kinds)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                rows.append(batch.slice(i, 1).to_pylist()[0])
                held += sum(rows[-1]["sizes"])
                if held >= DECODE_IDS:
                    yield documents(rows)
                    rows, held = [], 0
        if rows:
            yield documents(rows)

    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.binary()} if with_ids else {})
    return files.blocks.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    return read(write(docs, vocabulary, end_id))


