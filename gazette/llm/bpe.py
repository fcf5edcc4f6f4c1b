"""BPE by dynamic programming over prefixes.

Every prefix of a word has one encoding, and it ends with one token. Which one follows from shorter prefixes: among the
vocabulary's tokens that are suffixes of the prefix (one pass of a suffix-matching automaton finds them all), it is the
one that may stand after the last token of the prefix before it. Two tokens may stand together if no merge across their
border comes before the merges that made them. Back-pointers from the whole word then give the ids. The time is linear
in the word's length, however long the word.

Decoding turns the emitted ids back into tokens, a blank between them, as the vocabulary's file names no decoder.

Defined results. Null text: as an empty one, no ids and an empty decoded text. Repeated rows: each is encoded. An empty
table gives an empty result. Further columns don't matter.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.shared import give_back_memory
from gazette.llm.tokens import END_MARK, FINAL, Distinct, Encoder, byte_characters

#: Words in a worker's table, the longest of them in characters, and pairs of tokens that it has tested.
TABLE_WORDS, LONGEST, TABLE_PAIRS = 150_000, 32, 1_000_000


class WordBPE(Encoder):
    """Encoder and decoder of a vocabulary whose words end with a mark."""

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        ids = self.vocab = model["vocab"]
        strings = {i: t for t, i in ids.items()} | {i: t for t, i in self.specials.items()}
        most = max(strings) + 1
        #: by id, with the blank that follows
        self.tokens = pa.array([strings.get(i, "") + " " for i in range(most)], pa.large_string())
        self.decimals = pa.array([f"{i} " for i in range(most)], pa.large_string())
        unshown = {c: b for b, c in enumerate(byte_characters())}
        #: merge of two ids -> rank; id -> (rank of its merge, left id, right id)
        self.merge: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            l, r, both = ids[left], ids[right], ids[left + right]
            self.merge.setdefault((l, r), rank)
            self.parts.setdefault(both, (rank, l, r))
        self.matches = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for token, i in ids.items():
            if token in self.specials:
                continue
            body, final = (token[: -len(END_MARK)], True) if token.endswith(END_MARK) and len(token) > len(END_MARK) else (token, False)
            symbols = [unshown[c] for c in body]
            if len(symbols) > 1 and i not in self.parts:
                continue  # never made by a merge
            if final:
                symbols[-1] += FINAL
            self.matches.add_word("".join(map(chr, symbols)), (len(symbols), i))
        self.matches.make_automaton()
        self.together: dict[tuple[int, int], bool] = {}
        self.word_table: dict[str, list[int]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether [left, right] is the encoding of its text, where left and right are those of theirs.

        Take merges back, the latest first. Each step shows the two tokens that met at the border before it; if those
        have a merge that comes before the one just taken back, it would have come first. Of equal ranks, the one
        further left comes first.
        """
        key = (left, right)
        known = self.together.get(key)
        if known is not None:
            return known
        merge, parts = self.merge, self.parts
        until, right_too, out = len(self.parts) + len(merge) + 1, False, True
        while True:
            rank = merge.get((left, right))
            if rank is not None and (rank < until or rank == until and right_too):
                out = False
                break
            left_made, right_made = parts.get(left, (-1, 0, 0)), parts.get(right, (-1, 0, 0))
            if left_made[0] < 0 and right_made[0] < 0:
                break
            if left_made[0] > right_made[0]:
                until, right_too, left = left_made[0], False, left_made[2]
            else:  # of equal ranks the right one was made later
                until, right_too, right = right_made[0], True, right_made[1]
        self.together[key] = out
        return out

    def word_ids(self, word: str) -> list[int]:
        """Ids of one word of the pattern, or of a special token."""
        if word in self.specials:
            return [self.specials[word]]
        symbols = self.symbols(word)
        n = len(symbols)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        compatible, known = self.compatible, self.together
        for end, (size, i) in self.matches.iter(symbols):
            begin = end + 1 - size
            if begin == 0:
                ok = True
            else:
                before = last[begin]
                if before < 0:
                    continue
                ok = known.get((before, i))
                if ok is None:
                    ok = compatible(before, i)
            if ok:
                last[end + 1], back[end + 1] = i, begin
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]

    def of_words(self, words: list[str]) -> Distinct:
        table = self.word_table
        if len(table) > TABLE_WORDS:
            table.clear()
        if len(self.together) > TABLE_PAIRS:
            self.together.clear()
        ids: list[int] = []
        lengths = np.zeros(len(words), np.int64)
        for k, word in enumerate(words):
            got = table.get(word)
            if got is None:
                got = self.word_ids(word)
                if len(word) <= LONGEST:
                    table[word] = got
            ids += got
            lengths[k] = len(got)
        return Distinct([np.array(ids, np.uint32)], [lengths])

    def decode(self, ids: np.ndarray, ends: np.ndarray, what: pa.Array | None = None) -> Iterator[memoryview]:
        """Each text's tokens (or other strings of the ids), with a blank between, in UTF-8."""
        taken = (self.tokens if what is None else what).take(pa.array(ids))
        offsets, data = (taken.buffers()[k] for k in (1, 2))
        at = np.append(0, np.frombuffer(offsets, np.int64)[: len(ids) + 1][ends])
        raw = memoryview(data) if data is not None else memoryview(b"")
        return (raw[b : max(b, e - 1)] for b, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


_BY_PATH: dict[str, WordBPE] = {}


def word_bpe(path: str) -> WordBPE:
    """This worker's encoder; its tables live as long as the worker."""
    if path not in _BY_PATH:
        _BY_PATH[path] = WordBPE(path)
    return _BY_PATH[path]


def encoded(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded) of every row of docs(doc_id, text)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocabulary)
        for batch in batches:
            done = 0
            for ids, ends in bpe.encode(batch.column("text")):
                n = np.diff(ends, prepend=0)
                columns = [n, [hashlib.sha256(x).hexdigest() for x in bpe.decode(ids, ends, bpe.decimals)], [hashlib.sha256(x).hexdigest() for x in bpe.decode(ids, ends)]]
                if with_ids:
                    columns += [pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32))), [bytes(x).decode("utf-8") for x in bpe.decode(ids, ends)]]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(done, len(ends)), *[c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)]], names=["doc_id", *kinds])
                done += len(ends)
        give_back_memory()

    kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} | ({"ids": pa.list_(pa.int32()), "decoded": pa.string()} if with_ids else {})
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, schema)
