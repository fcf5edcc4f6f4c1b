"""Near-duplicate classes: DartMinHash signatures, banded joining, exact verification, connected components.

Texts are sets of shingles of five words (a shorter text is one shingle; words are separated by ASCII white space and
compared in lower case). Exact copies share a content key and go on as one. ``BANDS`` bands of ``ROWS`` coordinates put
a text into buckets; at a similarity of 0.8 two texts share none with a probability of 2e-5. Buckets with the same members
are taken once. Members of a bucket are then compared exactly, with their whole shingle sets, in groups of at most
``TILE`` texts and ``TILE_ELEMENTS`` shingles, about; a group gives a spanning forest of its links, never its pairs. In a
larger bucket all members are compared with a few pivots first, and those that these connect aren't compared with each
other again (see ``groups``). Components of the links are the classes. Every pair that shares a bucket is compared, or
known to be connected, or known by the distances from the pivots, or by the prefixes of ``finer``, not to be linked, so no
link is left out but for the probability above.

With ``weighted`` texts are bags: a shingle weighs as often as it occurs, signatures throw darts under these weights, and
the similarity is the sum of the lesser weights over the sum of the greater ones. The comparison writes the n-th occurrence
of a shingle as an element of its own, which makes that the similarity of sets. The default weighs every shingle 1.

Defined results. A null text is a class of its own; of null texts, those that share a doc_id, null ids too, share one. Texts without words are linked to equal texts only. Repeated rows
and exact copies are in one class. The class id is the least doc_id of the class, ignoring nulls. An empty table gives
an empty result. Further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm.components import components
from gazette.llm.dart_minhash import mix, signatures
from gazette.llm.shared import cut, cuts, give_back_memory, remove

SHINGLE, BANDS, ROWS, TILE, TILE_ELEMENTS = 5, 36, 6, 128, 1 << 20
#: A link: |A & B| * DEN >= |A | B| * NUM, a similarity of 0.8.
NUM, DEN = 4, 5
STEP_WORDS = 1 << 16
_TABLE_WORDS = 200_000
_WORD_TABLE: dict[bytes, int] = {}
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_PRIMES = np.array([pow(0x9E3779B97F4A7C15, SHINGLE - i, 1 << 64) for i in range(SHINGLE)], np.uint64)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    table = _WORD_TABLE
    if len(table) > _TABLE_WORDS:
        table.clear()
    for w in set(words).difference(table):
        table[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(table.__getitem__, words), np.uint64, len(words))


def _forget() -> None:
    """At the end of a task: the worker goes on to other work, which needs the memory."""
    _WORD_TABLE.clear()
    give_back_memory()


def _occurrences(text: str | None) -> np.ndarray:
    """Hashes of the text's shingles in their order."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=SHINGLE)], np.uint64)
    h = _word_hashes(words)
    n = len(h) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        total += h[i : i + n] * _PRIMES[i]
    return mix(total)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    return np.unique(_occurrences(text))


def numbered(text: str | None) -> np.ndarray:
    """Like shingles, but the n-th occurrence of a shingle is an element of its own; the first is the shingle itself."""
    found, counts = np.unique(_occurrences(text), return_counts=True)
    nth = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.uint64)
    each = np.repeat(found, counts)
    return np.unique(np.where(nth == 0, each, mix(each + nth * _GOLD)))


def key_of(text: str = "text") -> Column:
    """128 bits of the content; a null text's are of its doc_id, apart from all texts'."""
    return F.unhex(F.md5(F.coalesce(F.concat(F.lit("t"), F.col(text)), F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.lit(""))))


def banded(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, weighted: bool = False) -> DataFrame:
    """(doc_id, key, size, bands): the weight of a row's shingles, and a 64-bit hash for each band of its signature."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(1, bands + 1).astype(np.uint64)
        for batch in batches:
            texts = batch.column("text")
            out: list[np.ndarray | None] = [None] * batch.num_rows
            held: list[tuple[int, np.ndarray, np.ndarray | None]] = []

            def flush() -> None:
                if held:
                    sizes = np.array([len(s) for _, s, _ in held])
                    elements = np.concatenate([s for _, s, _ in held])
                    weights = np.concatenate([t for _, _, t in held]).astype(np.float64) if weighted else np.ones(len(elements))
                    signature = signatures(elements, weights, sizes, bands * rows).reshape(len(held), bands, rows)
                    h = np.zeros((len(held), bands), np.uint64) + salt
                    for r in range(rows):
                        h = mix(h * np.uint64(31) + signature[:, :, r])
                    for (i, _, _), x in zip(held, h.view(np.int64), strict=True):
                        out[i] = x
                    held.clear()

            due, counts = 0, np.zeros(batch.num_rows, np.int64)
            for i in range(batch.num_rows):
                if weighted:
                    found, times = np.unique(_occurrences(texts[i].as_py()), return_counts=True)
                    counts[i] = times.sum()
                else:
                    found, times = shingles(texts[i].as_py()), None
                    counts[i] = len(found)
                if len(found):
                    held.append((i, found, times))
                    due += len(found)
                    if due >= STEP_WORDS:
                        flush()
                        due = 0
            flush()
            sizes = [0 if x is None else bands for x in out]
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            values = np.concatenate([x for x in out if x is not None] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["doc_id", "key", "size", "bands"])
        _forget()

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key_of().alias("key"), "text")
    return keyed.mapInArrow(sign, "doc_id long, key binary, size long, bands array<long>")


def buckets(each: DataFrame) -> DataFrame:
    """(bucket) of each(bucket, key) with two different keys at least; of buckets with the same rows, one."""
    h = F.xxhash64("key")
    part = F.pmod(h, F.lit(1 << 38))
    groups = each.groupBy("bucket").agg(F.min(h).alias("low"), F.max(h).alias("high"), F.count("*").alias("n"), F.sum(part).alias("s")).where("low < high")
    return groups.groupBy("low", "high", "n", "s").agg(F.min("bucket").alias("bucket")).select("bucket")


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def spanning_links(sets: list[np.ndarray], heads: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets: each of the first heads sets (None: all) is compared with all after it, and a link between linked ones is left out."""
    n = len(sets)
    if n < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    marked = np.zeros(int(element.max()) + 1, bool)
    forest, out = _Forest(n), []
    for i in range(min(n - 1, n if heads is None else heads)):
        mine = element[begin[i] : begin[i + 1]]
        marked[mine] = True
        rest = begin[i + 1]
        common = np.bincount(owner[rest:][marked[element[rest:]]], minlength=n)
        marked[mine] = False
        for j in np.flatnonzero(common * DEN >= (sizes[i] + sizes - common) * NUM):
            if j > i and forest.link(i, int(j)):
                out.append((i, int(j)))
    return out


class _Pivots:
    """Some members of a large bucket, with which all others are compared. Main: those of the largest component of their links."""

    def __init__(self, keys: list[bytes], sets: list[np.ndarray]):
        self.keys, self.sizes = keys, np.array([len(s) for s in sets])
        self.elements, self.owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        self.links = spanning_links(sets)
        forest = _Forest(len(sets))
        for i, j in self.links:
            forest.link(i, j)
        self.component = np.array([forest.root(i) for i in range(len(sets))])
        self.main = self.component == np.bincount(self.component).argmax()

    def place(self, elements: np.ndarray) -> tuple[int, list[bytes]]:
        """(state, the pivots that connect the member to each component of pivots that it is linked to)."""
        common = np.bincount(self.owner[np.isin(self.elements, elements)], minlength=len(self.sizes))
        either = len(elements) + self.sizes - common
        linked = common * DEN >= either * NUM
        _, first = np.unique(self.component[linked], return_index=True)
        to = [self.keys[i] for i in np.flatnonzero(linked)[first]]
        # of distances 1 - J: whatever is within d of a settled member is within 2 d of a main pivot
        fringe = common * DEN >= either * (2 * NUM - DEN)
        return (SETTLED if (linked & self.main).any() else FRINGE if (fringe & self.main).any() else FAR), to


SETTLED, FRINGE, FAR, LINK = range(4)
PIVOTS = 16


def _tiles(where: str, tile: int) -> Column:
    """Number of groups for the rows of a bucket that fulfil the condition, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.expr(f"count_if({where})") / tile), F.ceil(F.expr(f"sum(if({where}, size, 0))") / TILE_ELEMENTS)).cast("int")


def _tile(key: str, tiles: str) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(3)), F.col(tiles)).cast("int")


def pivoted(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(bucket, key, size, state, other) from members(bucket, key, size, tiles) of large buckets.

    A bucket's members are dealt into slices, and its pivots are copied to each. A row with state LINK is a link of key to
    the pivot other. Every member has a row more: SETTLED, if linked to a main pivot; FRINGE, if it might be linked to a
    settled member; FAR, if it can't be.
    """
    order = Window.partitionBy("bucket").orderBy(F.xxhash64("key", F.lit(5)), "key")
    pivots = members.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= PIVOTS).select("bucket", "key", "size", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("slice"), F.lit(0).alias("p"))
    dealt = pivots.unionByName(members.select("bucket", "key", "size", _tile("key", "tiles").alias("slice"), F.lit(1).alias("p")))
    joined = dealt.join(sets.withColumnRenamed("_key", "_k"), F.col("key") == F.col("_k")).select("bucket", "slice", "p", "key", "elements")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, sets_, pivots = None, [], [], None
        for batch in batches:
            out: list[tuple] = []
            for bucket, part, p, key, raw in zip(*[batch.column(c).to_pylist() for c in ("bucket", "slice", "p", "key")], batch.column("elements"), strict=True):
                elements = np.frombuffer(raw.as_buffer(), np.uint64)
                if (bucket, part) != now:
                    now, keys, sets_, pivots = (bucket, part), [], [], None
                if p == 0:
                    keys.append(key)
                    sets_.append(elements.copy())
                    continue
                if pivots is None:
                    pivots = _Pivots(keys, sets_)
                    # the same in every slice; equal links are taken once later
                    out += [(bucket, keys[i], 0, LINK, keys[j]) for i, j in pivots.links]
                state, to = pivots.place(elements)
                out += [(bucket, key, 0, LINK, other) for other in to if other != key]
                out.append((bucket, key, len(elements), state, None))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "key", "size", "state", "other"])

    grouped = joined.repartition("bucket", "slice").sortWithinPartitions("bucket", "slice", "p", "key")
    return grouped.mapInArrow(compare, "bucket long, key binary, size long, state int, other binary")


def groups(members: DataFrame, sets: DataFrame, tile: int, kind: int = 0) -> tuple[DataFrame, list[DataFrame], DataFrame | None]:
    """(groups(bucket, kind, x, y, tail, key) whose members are to be compared, links that are found on the way, what is left) for members(bucket, key, size).

    A bucket of one tile is one group. A larger one is compared with pivots first: settled members are of one component, so
    no two of them are compared again. The fringe meets the settled ones, tile by tile, as heads and tails. The rest goes
    another round as long as a quarter of a bucket settles in each; then members(bucket, key, size, tiles) of more than a
    tile are left.
    """
    counts = cut(members.groupBy(F.col("bucket").alias("_b")).agg(_tiles("true", tile).alias("tiles")).where("tiles > 1"), "near-large")
    due = members.join(counts, F.col("bucket") == F.col("_b"), "left")
    whole = [F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(False).alias("tail"), F.col("key")]
    parts, found, left = [due.where("tiles is null").select("bucket", F.lit(kind).alias("kind"), *whole)], [], []
    due = due.where("tiles is not null").select("bucket", "key", "size", "tiles")
    while due.limit(1).count():
        kind += 2
        placed = cut(pivoted(due, sets), "near-pivoted")
        found.append(placed.where(F.col("state") == LINK).select(F.col("key").alias("u"), F.col("other").alias("v")))
        placed = placed.where(F.col("state") != LINK)
        plan = placed.groupBy(F.col("bucket").alias("_b")).agg(
            _tiles(f"state = {SETTLED}", tile).alias("s_tiles"), _tiles(f"state = {FRINGE}", tile).alias("f_tiles"), _tiles(f"state <> {SETTLED}", tile).alias("tiles"),
            F.expr(f"count_if(state = {FRINGE}) > 0").alias("fringed"), F.expr(f"4 * count_if(state = {SETTLED}) >= count(*)").alias("going"),
        )
        placed = cut(placed.join(cut(plan, "near-plan"), F.col("bucket") == F.col("_b")).drop("_b", "other"), "near-placed-members")
        every = lambda tiles: F.explode(F.sequence(F.lit(0), F.col(tiles) - 1))
        parts.append(placed.where(F.col("state") == FRINGE).select("bucket", F.lit(kind).alias("kind"), _tile("key", "f_tiles").alias("x"), every("s_tiles").alias("y"), F.lit(False).alias("tail"), "key"))
        parts.append(placed.where((F.col("state") == SETTLED) & F.col("fringed")).select("bucket", F.lit(kind).alias("kind"), every("f_tiles").alias("x"), _tile("key", "s_tiles").alias("y"), F.lit(True).alias("tail"), "key"))
        rest = placed.where(F.col("state") != SETTLED)
        due = rest.where("going and tiles > 1").select("bucket", "key", "size", "tiles")
        done = rest.where("not (going and tiles > 1)")
        parts.append(done.where("tiles = 1").select("bucket", F.lit(kind + 1).alias("kind"), *whole))
        left.append(done.where("tiles > 1").select("bucket", "key", "size", "tiles"))
    return reduce(DataFrame.unionByName, parts), found, reduce(DataFrame.unionByName, left) if left else None


def _pairs_of_tiles(members: DataFrame, kind: int) -> DataFrame:
    """Groups in which every two of members(bucket, key, tiles) of a bucket meet."""
    mine = _tile("key", "tiles")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda other: F.struct(F.least(mine, other).alias("x"), F.greatest(mine, other).alias("y")))
    return members.select("bucket", F.explode(pairs).alias("tile"), "key").select("bucket", F.lit(kind).alias("kind"), "tile.x", "tile.y", F.lit(False).alias("tail"), "key")


#: Sizes from one power of this to the next are a class.
STEP = 1.05


def finer(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(bucket, key, size): members(bucket, key, size) of large buckets in smaller ones, in which every two linked members of a bucket meet.

    Linked sets of sizes a and b have (a + b) * NUM / (NUM + DEN) elements in common at least. Where the elements of a bucket
    stand in one order, here the rarest in the bucket first, the first element that two linked sets have in common is
    therefore among the a + 1 minus that many first of the one, and likewise of the other. So each element of such a prefix
    is a bucket, apart for each pair of size classes, as the least size of the partner's class bounds the prefix. Texts that
    only have a frequent part in common have none of their prefixes' elements in common.
    """
    size_class = lambda n: F.floor(F.log(n) / F.log(F.lit(STEP))).cast("int")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                elements = np.frombuffer(batch.column("elements")[i].as_buffer(), np.int64)
                same = [pa.repeat(batch.column(c)[i], len(elements)) for c in ("bucket", "key", "size")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(elements)], names=["bucket", "key", "size", "element"])

    each = members.join(sets, F.col("key") == F.col("_key")).select("bucket", "key", "size", "elements").mapInArrow(spread, "bucket long, key binary, size long, element long")
    often = each.groupBy(F.col("bucket").alias("_b"), F.col("element").alias("_e")).agg(F.count("*").alias("n")).where("n > 1")
    ordered = Window.partitionBy("bucket", "key").orderBy(F.coalesce("n", F.lit(1)), "element")  # a text's elements
    ranked = each.join(often, (F.col("bucket") == F.col("_b")) & (F.col("element") == F.col("_e")), "left").withColumn("r", F.row_number().over(ordered)).where("n > 1")
    # longer than any prefix: a partner has four fifths of the size at least
    ranked = ranked.where((F.col("r") - 1) * DEN <= F.col("size") * (DEN - NUM))
    # of the partner's classes only those in the bucket count; their number grows with the logarithm of the longest text's size
    present = cut(members.groupBy(F.col("bucket").alias("_in")).agg(F.collect_set(size_class(F.col("size"))).alias("classes")), "near-classes")
    size = F.col("size")
    least = lambda of: F.floor(F.pow(F.lit(STEP), of) * (1 - 1e-9))

    def within(of: Column) -> Column:
        """The class holds sizes of partners, and the element is in the prefix for it."""
        in_reach = (least(of) * NUM <= size * DEN) & ((least(of + 1) + 1) * DEN >= size * NUM)
        return in_reach & ((F.col("r") - 1) * (NUM + DEN) <= size * (NUM + DEN) - (size + least(of)) * NUM)

    mine = ranked.join(present, F.col("bucket") == F.col("_in")).withColumn("mine", size_class(size)).withColumn("of", F.explode(F.filter("classes", within)))
    small = cut(mine.select(F.xxhash64("bucket", "element", F.least("mine", "of"), F.greatest("mine", "of")).alias("bucket"), "key", "size", "mine", (F.col("mine") == F.col("of")).alias("same")), "near-prefixes")
    # a bucket of two classes is for pairs across them
    met = small.groupBy(F.col("bucket").alias("_b")).agg(F.min("mine").alias("low"), F.max("mine").alias("high"), F.max("same").alias("one")).where("one or low < high").select("_b")
    return _in_buckets(small.join(met, F.col("bucket") == F.col("_b"), "left_semi").select("bucket", "key", "size"))


def _in_buckets(each: DataFrame) -> DataFrame:
    """The rows of each(bucket, key, size) in buckets that buckets() chooses, once each."""
    chosen = cut(buckets(each), "near-buckets")
    return cut(each.join(chosen.withColumnRenamed("bucket", "_bucket"), F.col("bucket") == F.col("_bucket")).select("bucket", "key", "size").distinct(), "near-members")


def links(docs: DataFrame, signed: DataFrame, tile: int = TILE, weighted: bool = False) -> DataFrame:
    """(u, v): keys of linked texts, enough of them to connect each class."""
    each = signed.select("key", "size", F.explode("bands").alias("bucket"))
    members = _in_buckets(each)
    one = signed.groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    wanted = cut(members.select("key").distinct().join(one, "key"), "near-wanted").select(F.col("key").alias("_key"), F.col("doc_id").alias("_id"))
    # wanted grows with the corpus, so it isn't broadcast even where it would fit now
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key_of().alias("_content"))
    texts = texts.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_content") == F.col("_key"))).select("_key", "text")

    elements_of = numbered if weighted else shingles

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array([elements_of(t.as_py()).tobytes() for t in batch.column("text")], pa.binary())], names=["_key", "elements"])
        _forget()

    sets = cut(texts.mapInArrow(to_sets, "_key binary, elements binary"), "near-sets")
    return linked(members, sets, tile)


#: Up to this many tiles of a bucket meet in pairs, each set copied once a tile: that is less work than a row for each element.
PAIRED_TILES = 32


def dealt_groups(members: DataFrame, sets: DataFrame, tile: int) -> tuple[DataFrame, list[DataFrame]]:
    """The groups and links of groups(); what it leaves meets tile by tile, but for buckets of many tiles, which go into finer ones first."""
    dealt, found, left = groups(members, sets, tile)
    if left is None:
        return dealt, found
    parts = [dealt, _pairs_of_tiles(left.where(F.col("tiles") <= PAIRED_TILES), 1 << 20)]
    many = left.where(F.col("tiles") > PAIRED_TILES).select("bucket", "key", "size")
    if many.limit(1).count():
        more, found_later, left = groups(finer(many, sets), sets, tile, 1 << 21)
        parts += [more] if left is None else [more, _pairs_of_tiles(left, 1 << 22)]
        found = found + found_later
    return reduce(DataFrame.unionByName, parts), found


def linked(members: DataFrame, sets: DataFrame, tile: int = TILE) -> DataFrame:
    """(u, v): links within the buckets of members(bucket, key, size), enough to connect their components. sets: (_key, elements)."""
    dealt, found_before = dealt_groups(members, sets, tile)
    joined = dealt.join(sets, F.col("key") == F.col("_key")).select("bucket", "kind", "x", "y", "tail", "key", "elements")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                group = zip(*[batch.column(c).to_pylist() for c in ("bucket", "kind", "x", "y")], strict=True)
                yield from zip(group, *[batch.column(c).to_pylist() for c in ("tail", "key")], batch.column("elements"), strict=True)

        def found(keys: list[bytes], sets_: list[np.ndarray], heads: int) -> Iterator[tuple[bytes, bytes]]:
            return ((keys[i], keys[j]) for i, j in spanning_links(sets_, heads))

        out: list[tuple[bytes, bytes]] = []
        now, keys, held, heads = None, [], [], 0
        for group, tail, key, elements in chain(rows(), [(None, False, b"", None)]):
            if group != now:
                out += found(keys, held, heads)
                now, keys, held, heads = group, [], [], 0
            if group is not None:
                heads += not tail
                keys.append(key)
                held.append(np.frombuffer(elements.as_buffer(), np.uint64))
            if len(out) > 10_000 or group is None:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], names=["u", "v"])
                out = []

    grouped = joined.repartition("bucket", "kind", "x", "y").sortWithinPartitions("bucket", "kind", "x", "y", "tail", "key")
    return reduce(DataFrame.unionByName, found_before, grouped.mapInArrow(compare, "u binary, v binary"))


def classes(docs: DataFrame, tile: int = TILE, weighted: bool = False) -> DataFrame:
    """(doc_id, key, class_id) for every row of docs(doc_id, text); weighted: by shingles' counts."""
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    outside = cuts(spark)
    signed = cut(banded(docs, weighted=weighted), "near-signed")
    roots = components(cut(links(docs, signed, tile, weighted), "near-links")).select(F.col("node").alias("_node"), "root")
    placed = cut(signed.select("doc_id", "key").join(roots, F.col("key") == F.col("_node"), "left").select("doc_id", "key", F.coalesce("root", "key").alias("root")), "near-placed")
    heads = cut(placed.groupBy("root").agg(F.min("doc_id").alias("class_id")), "near-heads").select(F.col("root").alias("_root"), "class_id")
    remove(spark, [p for p in cuts(spark)[:-2] if p not in outside])  # all but the two tables of the result
    return placed.join(heads, F.col("root") == F.col("_root")).select("doc_id", "key", "class_id")


def deduped(docs: DataFrame, weighted: bool = False) -> DataFrame:
    """The rows of docs whose doc_id is their class's least; rows with a null doc_id stay only where their class has no other."""
    gone = classes(docs, weighted=weighted).where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("_gone"), F.col("key").alias("_gone_key")).distinct()
    keyed = docs.withColumn("_content", key_of())
    return keyed.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_gone")) & (F.col("_content") == F.col("_gone_key")), "left_anti").drop("_content")
