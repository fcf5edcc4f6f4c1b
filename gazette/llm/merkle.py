"""Merkle manifest of a table, with a proof for every row by pointer jumping.

A row's leaf is the SHA-256 of its fields. Leaves of one language, in ascending order of doc_id, are the lowest level of
that language's tree; every two consecutive nodes (the last alone, where their number is odd) hash to their parent, and
what remains is the language's subroot. The subroots, in order of language, are the leaves of one more tree, whose top is the root.

Rows are numbered by range partitions and the counts before them. Trees are hashed in blocks of ``2 ** BLOCK_LEVELS``
consecutive nodes, each in one pass over its sorted rows, so a tree of n leaves takes log(n) / ``BLOCK_LEVELS`` steps.
Every node then holds its sibling, the segment of one step towards the root. A round of jumping joins nodes with their
ancestors at the end of their segments and appends those' segments, which doubles the distance; nodes between the levels
that a later round begins at are left behind, so the tables shrink to the leaves, whose segments are the proofs.

Defined results. A null field counts as ``-``. Null doc_ids come first, null languages too; rows of one doc_id are
ordered by their leaf, and equal rows are leaves of their own beside each other. A single row is its own subroot and root,
with an empty proof. An empty table gives an empty result and has no root. Further columns are no part of a leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from gazette.llm.shared import cut, cuts, give_back_memory, remove

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that are hashed together: 256 nodes are held at once.
BLOCK_LEVELS = 8
DIGEST = 32


def leaf(fields: list[Column]) -> Column:
    """Digest of a row's fields, each with its length in bytes, so that no two rows run together."""
    parts = []
    for f in fields:
        value = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def parent(digests: list[bytes]) -> bytes:
    """Nodes hash as their digests' hexadecimal text."""
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


def numbered(rows: DataFrame, order: list[str], group: str | None = None) -> DataFrame:
    """rows with idx, from 0 in each group by order, and the group's n. order begins with group. Rows must be a written table, so that a task that runs again deals them alike."""
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = cut(placed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "merkle-ordered")
    keys = [group] if group else []
    # at most a row for each group and one for each partition
    runs = cut(placed.groupBy(*keys, "_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first")), "merkle-runs")
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_run"), (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("n"))
    same = F.col("_part") == F.col("_run")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return placed.join(runs, same).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("idx"), "n")


def _hashed(nodes: DataFrame, base: int) -> DataFrame:
    """nodes(g, idx, n, digest, payload) of level base as rows of the tree for the next levels, and their tops: (g, level, idx, n, height, sibling, digest, payload); digest of the top rows alone."""
    schema = StructType([StructField("g", LongType()), StructField("level", IntegerType()), StructField("idx", LongType()), StructField("n", LongType()), StructField("height", IntegerType()), StructField("sibling", BinaryType()), StructField("digest", BinaryType()), StructField("payload", nodes.schema["payload"].dataType)])

    def block(g: int, n: int, first: int, digests: list[bytes]) -> list[tuple]:
        """Rows of the levels over one block: (level, idx, sibling, digest, which of the block's rows)."""
        height = (n - 1).bit_length()
        level, at, rows = base, first, []
        while level < base + BLOCK_LEVELS and level < height:
            for i, _ in enumerate(digests):
                other = i ^ 1
                rows.append((g, level, at + i, n, height, digests[other] if other < len(digests) else None, None, i if level == base else None))
            digests = [parent(digests[i : i + 2]) for i in range(0, len(digests), 2)]
            level, at = level + 1, at >> 1
        rows.append((g, level, at, n, height, None, digests[0], 0 if level == base else None))
        return rows

    def hash_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digests, payloads, first = None, [], [], 0
        kind = None

        def flush() -> pa.RecordBatch:
            rows = block(key[0], key[2], first, digests)
            held = pa.concat_arrays(payloads)
            columns = [pa.array(c, pa.from_numpy_dtype("int32") if k in (1, 4) else pa.int64() if k < 5 else pa.binary()) for k, c in enumerate(list(zip(*rows, strict=True))[:7])]
            return pa.RecordBatch.from_arrays([*columns, held.take(pa.array([r[7] for r in rows], pa.int64()))], names=schema.names)

        for batch in batches:
            kind = batch.column("payload").type
            for k, (g, idx, n, digest) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("g", "idx", "n", "digest")), strict=True)):
                if (g, idx >> BLOCK_LEVELS, n) != key:
                    if key:
                        yield flush()
                    key, digests, payloads, first = (g, idx >> BLOCK_LEVELS, n), [], [], idx
                digests.append(digest)
                payloads.append(batch.column("payload").slice(k, 1))
        if key:
            yield flush()
        give_back_memory()

    dealt = nodes.select("g", "idx", "n", "digest", "payload").repartition("g", F.shiftright("idx", BLOCK_LEVELS)).sortWithinPartitions("g", "idx")
    return dealt.mapInArrow(hash_blocks, schema)


def tree(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes(g, level, idx, n, height, segment, payload), tops(g, digest)) of the trees over leaves(g, idx, n, digest, payload); payload stands with the leaves."""
    base, parts, tops = 0, [], []
    nodes = leaves
    while True:
        rows = cut(_hashed(nodes, base), f"merkle-level-{base}")
        parts.append(rows.where(F.col("digest").isNull() | (F.col("level") == 0)))
        at_top = rows.where(F.col("digest").isNotNull())
        tops.append(at_top.where(F.col("level") == F.col("height")))
        rest = at_top.where(F.col("level") < F.col("height"))
        base += BLOCK_LEVELS
        if rest.isEmpty():
            break
        nodes = rest.select("g", "idx", "n", "digest", "payload")
    everything, ends = parts[0], tops[0]
    for x, y in zip(parts[1:], tops[1:], strict=True):
        everything, ends = everything.unionByName(x), ends.unionByName(y)
    return everything.select("g", "level", "idx", "n", "height", F.coalesce("sibling", F.lit(b"")).alias("segment"), "payload"), ends.select("g", "digest")


def jumped(nodes: DataFrame) -> DataFrame:
    """(g, idx, n, segment, payload): the leaves with all siblings on their way to the top, from nodes of tree()."""
    spark = nodes.sparkSession
    levels = nodes.agg(F.max("height")).first()[0] or 0
    outside = cuts(spark)
    distance, rows = 1, nodes
    while distance < levels:
        stale = [p for p in cuts(spark) if p not in outside]
        start = rows.where(F.col("level") % (2 * distance) == 0)
        far = rows.where(F.col("level") % (2 * distance) == distance)
        far = far.select(F.col("g").alias("_g"), (F.col("level") - distance).alias("_level"), F.col("idx").alias("_idx"), F.col("segment").alias("_more"))
        ends_below = F.col("level") + distance < F.col("height")
        on = (F.col("g") == F.col("_g")) & (F.col("level") == F.col("_level")) & (F.shiftright("idx", distance) == F.col("_idx"))
        on_way = start.where(ends_below).join(far, on).withColumn("segment", F.concat("segment", "_more")).select(*rows.columns)
        rows = cut(on_way.unionByName(start.where(~ends_below)), f"merkle-jump-{distance}")
        remove(spark, stale)
        distance *= 2
    return rows.where("level = 0").select("g", "idx", "n", "segment", "payload")


def manifest(docs: DataFrame, group: str = "lang", key: str = "doc_id", fields: tuple[str, ...] = FIELDS, claims: Mapping[str, Column] | None = None) -> DataFrame:
    """For each row of docs: key, group, idx (in its group), n (of its group), n_groups, group_idx, leaf, claimed, subroot, root and proof, digests as 32 bytes each, the proof their concatenation.

    claims: fields whose values are to be verified instead of the row's own; claimed is the leaf that follows from them.
    """
    spark = docs.sparkSession
    outside = cuts(spark)
    claims = claims or {}
    changed = F.lit(False)
    for name, value in claims.items():
        changed = changed | ~F.col(name).eqNullSafe(value)
    own, other = leaf([F.col(f) for f in fields]), leaf([claims.get(f, F.col(f)) for f in fields])
    rows = docs.select(F.col(key).alias("key"), F.col(group).alias("group"), own.alias("leaf"), (F.when(changed, other) if claims else F.lit(None).cast("binary")).alias("other"))
    # the salt, which is written, splits equal rows between ranges
    leaves = cut(rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())), "merkle-leaves")
    placed = cut(numbered(leaves, ["group", "key", "leaf", "salt"], "group"), "merkle-numbered")
    groups = cut(placed.where("idx = 0").select("group", F.col("n").alias("size")), "merkle-groups")
    groups = cut(numbered(groups, ["group"]).select(F.col("group").alias("_group"), F.col("idx").alias("g"), F.col("n").alias("n_groups")), "merkle-group-numbers")
    payload = F.struct("key", "leaf", F.coalesce("other", "leaf").alias("claimed"), "group", "n_groups")
    start = placed.join(groups, F.col("group").eqNullSafe(F.col("_group"))).select("g", "idx", "n", F.col("leaf").alias("digest"), payload.alias("payload"))
    nodes, subroots = tree(start)
    upper = groups.join(subroots, "g").select(F.lit(0).cast("long").alias("g"), F.col("g").alias("idx"), F.col("n_groups").alias("n"), "digest", F.struct(F.col("digest").alias("subroot")).alias("payload"))
    upper_nodes, root = tree(upper)
    top = jumped(upper_nodes).crossJoin(F.broadcast(root.select(F.col("digest").alias("root"))))  # one row
    top = top.select(F.col("idx").alias("g"), F.col("payload.subroot").alias("subroot"), F.col("segment").alias("upper"), "root")
    out = jumped(nodes).join(top, "g").select("payload.*", "g", "idx", "n", "subroot", "root", F.concat("segment", "upper").alias("proof"))
    out = cut(out.select(F.col("key").alias(key), *([F.col("group").alias(group)] if group != key else []), "leaf", "claimed", F.col("g").alias("group_idx"), "idx", "n", "n_groups", "subroot", "root", "proof"), "merkle-manifest")
    remove(spark, [p for p in cuts(spark)[:-1] if p not in outside])
    return out


def folded(leaf_digest: bytes, proof: bytes, path: list[tuple[int, int]]) -> bytes:
    """The root that follows from a leaf and its siblings; path: (place, number of nodes) at the lowest level of each tree on the way."""
    node, at = leaf_digest, 0
    for idx, n in path:
        while n > 1:
            if idx ^ 1 < n:
                sibling = proof[at : at + DIGEST]
                node, at = parent([sibling, node] if idx & 1 else [node, sibling]), at + DIGEST
            else:
                node = parent([node])
            idx, n = idx >> 1, n + 1 >> 1
    return node


def verified(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root (digests as text) and verified, for rows of manifest(): the root recomputed from each claimed leaf and the proof."""
    schema = StructType([rows.schema[key], *[StructField(c, StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for leaf_, claimed, g, idx, n, groups, subroot, root, proof in zip(*(batch.column(c).to_pylist() for c in ("leaf", "claimed", "group_idx", "idx", "n", "n_groups", "subroot", "root", "proof")), strict=True):
                out.append((leaf_.hex(), subroot.hex(), root.hex(), hashlib.sha256(proof.hex().encode()).hexdigest(), folded(claimed, proof, [(idx, n), (g, groups)]).hex()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(key), *[pa.array(c, pa.string()) for c in columns]], names=schema.names)
        give_back_memory()

    return rows.mapInArrow(fold, schema).withColumn("verified", F.col("folded_root") == F.col("root"))
