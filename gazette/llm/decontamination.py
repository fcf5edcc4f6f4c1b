"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

Words are runs of ASCII letters and digits, in lower case, and of characters above U+007F. The automaton holds every
sequence of words that occurs in an item. A document's words stream through it: at each word it knows the longest sequence
that ends there and occurs in some item. Where that reaches ``WINDOW`` words, or a shorter item as a whole, these words
are hit; the items follow from the state of the last ``WINDOW`` words.

Items are dealt to shards of at most about ``SHARD_WORDS`` words (longer items in pieces that overlap by a window less a
word), a task builds the automaton of each, and a shard's automaton, bounded so, is broadcast. With one shard documents
are read once and nothing is shuffled; with more they are read once a shard, and the few hits meet by document.

Defined results. Null texts, and texts without a word, have no words and no hits; items without a word match nothing. Rows
of documents are judged each by itself, whatever their doc_id. Items that share an item_id count as one; those with a null
item_id hit words but aren't counted. An empty table of items hits nothing, an empty one of documents gives an empty
result. Further columns don't matter, or are carried as they are; names that begin with ``_dc_`` are the operator's.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from gazette.llm.shared import cut, cuts, give_back_memory, remove

#: A word before its letters are put in lower case.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes to words: letters in lower case, all that isn't part of a word as a blank. Bytes from 0x80 belong to words.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WINDOW = 10
#: Words of an automaton, and of a piece of a long item.
SHARD_WORDS, PIECE_WORDS = 1 << 18, 1 << 14
#: Bytes of text that become words at once, for a bound on memory.
STEP_BYTES = 1 << 20
SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))


class Automaton:
    """Of (item_id, words) with window as the length that counts; shorter items count as wholes."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], whole: list[bool], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        texts = [[self.ids.setdefault(w, len(self.ids)) for w in words] for _, words in items]
        self.n_words = max(1, len(self.ids))
        self.length, self.link, self.next = [0], [-1], {}
        edges: list[set[int]] = [set()]
        for text in texts:
            last = 0
            for w in text:
                last = self._extend(last, w, edges)
        order = np.argsort(self.length, kind="stable").tolist()
        #: The state of the last window words of a state's sequences, -1 where they are shorter.
        self.window_state = [-1] * len(order)
        for v in order[1:]:
            up = self.link[v]
            self.window_state[v] = self.window_state[up] if self.length[up] >= window else v if self.length[v] >= window else -1
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str | None]]] = {}
        for (item, _), text, is_whole in zip(items, texts, whole, strict=True):
            v = 0
            for n, w in enumerate(text, 1):
                v = self.next[v * self.n_words + w]
                if n >= window and item is not None:
                    at = self.window_state[v]
                    self.items.setdefault(at, set()).add(item)
            if text and len(text) < window and is_whole:
                self.short.setdefault(v, []).append((len(text), item))
        #: The nearest state on the way of suffix links, itself included, that ends a short item; -1 for none.
        self.short_state = [-1] * len(order)
        if self.short:
            for v in order[1:]:
                self.short_state[v] = v if v in self.short else self.short_state[self.link[v]]
        #: The fewest words in a row that can hold a match.
        self.least = min([n for rows in self.short.values() for n, _ in rows] + [window])

    def _extend(self, last: int, w: int, edges: list[set[int]]) -> int:
        length, link, step, n = self.length, self.link, self.next, self.n_words

        def clone(of: int, size: int, head: int) -> int:
            """A state for the sequences of of up to size, which head and its suffixes lead to."""
            new = len(length)
            length.append(size)
            link.append(link[of])
            edges.append(set(edges[of]))
            for x in edges[of]:
                step[new * n + x] = step[of * n + x]
            link[of] = new
            while head >= 0 and step.get(head * n + w) == of:
                step[head * n + w] = new
                head = link[head]
            return new

        there = step.get(last * n + w)
        if there is not None:  # an earlier item has it
            return there if length[there] == length[last] + 1 else clone(there, length[last] + 1, last)
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        edges.append(set())
        at = last
        while at >= 0 and at * n + w not in step:
            step[at * n + w] = new
            edges[at].add(w)
            at = link[at]
        if at >= 0:
            to = step[at * n + w]
            link[new] = to if length[to] == length[at] + 1 else clone(to, length[at] + 1, at)
        return new

    def stream(self, words: list[int]) -> tuple[list[list[int]], set[int], set[str]]:
        """(hit spans, merged; states of windows that occur; short items that occur) of words that all are items' words."""
        step, length, link, n, window = self.next.get, self.length, self.link, self.n_words, self.window
        spans: list[list[int]] = []
        states: set[int] = set()
        short: set[str] = set()
        v = size = 0
        for i, w in enumerate(words):
            while (to := step(v * n + w)) is None and v:
                v = link[v]
                size = length[v]
            if to is None:
                size = 0
                continue
            v, size = to, size + 1
            hit = 0
            if size >= window:
                hit = size
                states.add(self.window_state[v])
            s = self.short_state[v]
            while s >= 0:
                for m, item in self.short[s]:
                    if m <= size:
                        hit = max(hit, m)
                        if item is not None:
                            short.add(item)
                s = self.short_state[link[s]] if link[s] >= 0 else -1
            if hit:
                start = i + 1 - hit
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i + 1])
        return spans, states, short


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


def _numbers(ids: dict[bytes, int], texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, numbers of its words and the next texts', each text's end), in steps; a word that isn't in ids is -1."""
    kind, mark = np.int32, b"\x01"

    def numbered(raw: bytes) -> np.ndarray:
        words = raw.split()
        return np.fromiter(map(ids.get, words, repeat(-1)), kind, len(words))

    def step(first: int, held: list[bytes]) -> tuple[int, np.ndarray, np.ndarray]:
        words = b"".join(x + b" \x01 " for x in held).split()
        numbers = np.fromiter(map(known, words, repeat(-1)), kind, len(words))
        marks = np.flatnonzero(numbers == -2)
        return first, numbers[numbers != -2], marks - np.arange(len(marks))

    known = {**ids, mark: -2}.get
    held: list[bytes] = []
    size = first = 0
    for i, text in enumerate(texts):
        raw = text.as_buffer().to_pybytes().translate(TABLE) if text.is_valid else b""
        if len(raw) > STEP_BYTES:  # in portions, cut at blanks
            if held:
                yield step(first, held)
            parts, at = [], 0
            while at < len(raw):
                end = raw.find(b" ", min(len(raw), at + STEP_BYTES))
                end = len(raw) if end < 0 else end
                parts.append(numbered(raw[at:end]))
                at = end
            numbers = np.concatenate(parts)
            yield i, numbers, np.array([len(numbers)])
            held, size, first = [], 0, i + 1
            continue
        held.append(raw)
        size += len(raw)
        if size >= STEP_BYTES:
            yield step(first, held)
            held, size, first = [], 0, i + 1
    if held:
        yield step(first, held)


def _streamed(automaton: Automaton, texts: pa.Array) -> Iterator[tuple[int, list, list]]:
    """(n_words, spans, items) of each text."""
    for _, numbers, ends in _numbers(automaton.ids, texts):
        starts = np.append(0, ends[:-1])
        inside = np.zeros(len(numbers) + 2, np.int8)
        inside[1:-1] = numbers >= 0
        turn = np.diff(inside)
        a, b = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        # a run of items' words ends where its text does
        breaks = ends[(ends > 0) & (ends < len(numbers))]
        a, b = np.unique(np.concatenate([a, breaks[inside[breaks + 1] == 1]])), np.unique(np.concatenate([b, breaks[inside[breaks] == 1]]))
        long = b - a >= automaton.least
        found: dict[int, tuple[list, set, set]] = {}
        for x, y in zip(a[long].tolist(), b[long].tolist(), strict=True):
            spans, states, short = automaton.stream(numbers[x:y].tolist())
            if spans:
                of = int(np.searchsorted(ends, x, side="right"))
                before = found.setdefault(of, ([], set(), set()))
                shift = x - int(starts[of])
                before[0].extend([s + shift, e + shift] for s, e in spans)
                before[1].update(states)
                before[2].update(short)
        for k in range(len(ends)):
            spans, states, short = found.get(k, ((), (), ()))
            items = set(short).union(*(automaton.items.get(s, ()) for s in states))
            yield int(ends[k] - starts[k]), spans, sorted(items)


def _scan(docs: DataFrame, automaton: Broadcast) -> DataFrame:
    """docs with _dc_words, _dc_spans and _dc_items; text must be among the columns."""
    schema = StructType([*docs.schema.fields, StructField("_dc_words", LongType()), StructField("_dc_spans", SPANS), StructField("_dc_items", ArrayType(StringType()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = list(_streamed(automaton.value, batch.column("text")))
            spans = pa.array([[{"start": a, "end": b} for a, b in r[1]] for r in rows], span)
            added = [pa.array([r[0] for r in rows], pa.int64()), spans, pa.array([r[2] for r in rows], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(batch.columns + added, names=[*batch.schema.names, "_dc_words", "_dc_spans", "_dc_items"])
        give_back_memory()

    return docs.mapInArrow(scan, schema)


def _pieces(items: DataFrame, window: int) -> DataFrame:
    """(item, words, whole): the words of items, long ones in pieces that overlap by a window less a word."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text"), strict=True):
                words = words_of(text.as_py())
                rows = [(item, words[at : at + PIECE_WORDS + window - 1], len(words) <= PIECE_WORDS + window - 1) for at in range(0, max(1, len(words) - window + 1), PIECE_WORDS)]
                for r in rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(r, (pa.string(), pa.list_(pa.binary()), pa.bool_()), strict=True)], names=["item", "words", "whole"])

    return items.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(pieces, "item string, words array<binary>, whole boolean").where(F.size("words") > 0).distinct()


def automata(items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> Iterator[Broadcast]:
    """The broadcast automaton of each shard of items(item_id, text); one of nothing where there are no items."""
    spark = items.sparkSession
    pieces = cut(_pieces(items, window), "benchmark-pieces")
    total = pieces.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_words))
    place = lambda n: F.pmod(F.xxhash64("item", "words"), F.lit(n)).alias("shard")
    while total > shard_words and pieces.groupBy(place(shards)).agg(F.sum(F.size("words")).alias("n")).agg(F.max("n")).first()[0] > 2 * shard_words:
        shards *= 2  # ends, as a piece is far smaller than a shard

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(r.item, list(r.words)) for r in pdf.itertuples()]
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "automaton": [pickle.dumps(Automaton(rows, pdf["whole"].tolist(), window))]})

    built = cut(pieces.withColumn("shard", place(shards)).groupBy("shard").applyInPandas(build, "shard long, automaton binary"), "benchmark-automata")
    some = False
    for shard in range(shards):
        for row in built.where(F.col("shard") == shard).select("automaton").collect():  # one automaton of bounded size
            some = True
            yield spark.sparkContext.broadcast(pickle.loads(row["automaton"]))
    if not some:
        yield spark.sparkContext.broadcast(Automaton([], [], window))


@F.pandas_udf(SPANS)
def _merged(spans: pd.Series) -> pd.Series:
    def one(rows) -> list[dict]:
        out: list[dict] = []
        for r in sorted(((r["start"], r["end"]) for r in (rows if rows is not None else ()))):
            if out and out[-1]["end"] >= r[0]:
                out[-1]["end"] = max(out[-1]["end"], r[1])
            else:
                out.append({"start": r[0], "end": r[1]})
        return out

    return spans.map(one)


def matched(docs: DataFrame, items: DataFrame, *carried: str, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """carried columns of each row of docs(doc_id, text), with n_words, spans (of hit words, numbered from 0, end exclusive), n_hit and item_ids (as strings, sorted)."""
    outside = cuts(docs.sparkSession)
    rows = docs.select(*dict.fromkeys((*carried, "doc_id", "text")))
    shards = list(automata(items.select("item_id", "text"), window, shard_words))
    remove(docs.sparkSession, [p for p in cuts(docs.sparkSession) if p not in outside])
    out = _scan(rows, shards[0])
    if len(shards) > 1:
        keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("_dc_a"), F.sha2("text", 256).alias("_dc_b"))
        key = ["doc_id", "_dc_a", "_dc_b"]
        found = [cut(_scan(keyed, x).where(F.size("_dc_spans") > 0).select(*key, "_dc_spans", "_dc_items").distinct(), "benchmark-hits") for x in shards[1:]]
        hits = found[0]
        for x in found[1:]:
            hits = hits.unionByName(x)
        # rows of one doc_id and text have the same hits, so a key has a row a shard at most
        hits = hits.groupBy(*[F.col(k).alias(f"_dc_k{n}") for n, k in enumerate(key)]).agg(F.flatten(F.collect_list("_dc_spans")).alias("_dc_more"), F.flatten(F.collect_list("_dc_items")).alias("_dc_names"))
        out = out.withColumns({"_dc_a": F.xxhash64("text"), "_dc_b": F.sha2("text", 256)})
        same = F.lit(True)
        for n, k in enumerate(key):
            same = same & F.col(k).eqNullSafe(F.col(f"_dc_k{n}"))
        out = out.join(hits, same, "left")
        both = lambda a, b: F.when(F.col(b).isNull(), F.col(a)).otherwise(F.concat(a, b))
        out = out.withColumns({"_dc_spans": _merged(both("_dc_spans", "_dc_more")), "_dc_items": F.array_sort(F.array_distinct(both("_dc_items", "_dc_names")))})
    n_hit = F.aggregate("_dc_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    own = {"n_words", "spans", "n_hit", "item_ids"}
    return out.select(*[c for c in carried if c not in own], F.col("_dc_words").alias("n_words"), F.col("_dc_spans").alias("spans"), n_hit.alias("n_hit"), F.col("_dc_items").alias("item_ids"))


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the items' ids, sorted as strings, comma-joined) and contaminated."""
    found = matched(docs, items, "doc_id", window=window, shard_words=shard_words)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@F.pandas_udf(StringType())
def _without(texts: pd.Series, spans: pd.Series) -> pd.Series:
    def one(text: str | None, rows) -> str | None:
        if text is None or rows is None or not len(rows):
            return text
        words = [m.span() for m in WORD.finditer(text)]
        out, at = [], 0
        for r in rows:
            out.append(text[at : words[r["start"]][0]])
            at = words[r["end"] - 1][1]
        return "".join([*out, text[at:]])

    return pd.Series([one(t, s) for t, s in zip(texts, spans, strict=True)])


def cleaned(docs: DataFrame, items: DataFrame, longest_span: int = WINDOW - 1, most_coverage: float = 0.5, window: int = WINDOW) -> DataFrame:
    """docs without spans of more than longest_span hit words, and without rows of whose words more than most_coverage are hit. What stands between and around the spans stays as it is."""
    found = matched(docs.withColumns({f"_dc_c{n}": F.col(f"`{c}`") for n, c in enumerate(docs.columns)}), items, *[f"_dc_c{n}" for n in range(len(docs.columns))], window=window)
    kept = found.where(F.col("n_hit") <= F.col("n_words") * F.lit(most_coverage))
    long = F.filter("spans", lambda s: s["end"] - s["start"] > longest_span)
    return kept.select(*[(_without(F.col(f"_dc_c{n}"), long) if c == "text" else F.col(f"_dc_c{n}")).alias(c) for n, c in enumerate(docs.columns)])
