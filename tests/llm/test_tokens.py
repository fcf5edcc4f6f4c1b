"""Packing, token files and BPE against the tokenizers library and plain Python."""

import functools
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gazette.llm import bpe, huffman, packing
from gazette.llm.tokens import encoder, vocabulary

WORD, BYTE = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")
ODD = ["", None, "a", "  two  blanks\n\n\nlines \t tab", "ΣΣΑΣ ΟΔΟΣ İstanbul é", "it's I'LL we'd '' 's", "<|endoftext|>  x <|startoftext|>", "a\x1cb\x85c　d", "漢字 かな 한글 😀👩‍👩‍👧", "a" * 5000, "ab " * 9000, "\x00 nul", "x" * 4095 + " y"]


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(3)
    letters = " \n\t'sdtmlr9Σİé!?.-_<|>漢aAbB😀\x1c\xa0"
    texts = ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 80))) for _ in range(200)] + ["same copy here"] * 60
    rows = [(i * 7 % 997, t, "clash", 5) for i, t in enumerate(texts)]
    rows += [rows[1], rows[1], (None, "no id", None, None), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, length string, n_tokens int").repartition(3)


@functools.cache
def tokenizer(path):
    return Tokenizer.from_file(path)


def library(path, text):
    return tokenizer(path).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def ids_of(tokens, texts):
    out = []
    for ids, ends in tokens.encode(pa.array(texts, pa.string())):
        out += [x.tolist() for x in np.split(ids, ends[:-1])]
    return out


def test_encoder_is_the_library(docs):
    texts = [r["text"] for r in docs.collect()]
    for path in (WORD, BYTE):
        t = Tokenizer.from_file(path)
        assert ids_of(encoder(path), texts) == [t.encode(text or "", add_special_tokens=False).ids for text in texts]
        assert ids_of(encoder(path), []) == []


def test_every_code_point_as_in_the_library():
    """Between letters, digits and marks; sixteen code points a text. Of the large blocks of Han, Hangul and unassigned ones, every 61st."""
    large = [range(0x3400, 0xA000), range(0xAC00, 0xD7A4), range(0x20000, 0x110000)]
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c % 61 == 0 or not any(c in r for r in large))]
    texts = [" ".join(f"x{c}y 1{c}2, {c}" for c in points[i : i + 16]) for i in range(0, len(points), 16)]
    encoders = [(WORD, encoder(WORD)), (BYTE, encoder(BYTE)), (WORD, bpe.word_bpe(WORD))]
    want = {path: [e.ids for e in Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)] for path in (WORD, BYTE)}
    for path, tokens in encoders:
        wrong = [text for text, a, b in zip(texts, ids_of(tokens, texts), want[path], strict=True) if a != b]
        assert wrong == []


def test_long_chunks_and_blanks():
    texts = ["a" * 300_000, "ab" * 100_000, " " * 300_000 + "x", "\n" * 200_000, "é" * 100_000, "." * 100_000, "\x01 \x01a\x01", "<|endoftext|>\x01<|endoftext|> \u3000\u0301e"]
    for path, tokens in ((WORD, encoder(WORD)), (BYTE, encoder(BYTE)), (WORD, bpe.word_bpe(WORD))):
        t = Tokenizer.from_file(path)
        assert ids_of(tokens, texts) == [t.encode(text, add_special_tokens=False).ids for text in texts]


def test_prefix_bpe(docs):
    t = Tokenizer.from_file(WORD)
    want = []
    for r in docs.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    got = [tuple(r) for r in bpe.encoded(docs, WORD).collect()]
    assert Counter(got) == Counter(want)


def test_compatible_pairs_are_those_that_the_library_keeps():
    w, t, rnd = bpe.WordBPE(WORD), Tokenizer.from_file(WORD), random.Random(5)
    starts = [s for s in w.vocab if not s.endswith("</w>") and s.isascii() and s.isalpha() and s.islower()]
    ends = [s for s in w.vocab if s.endswith("</w>") and s[:-4].isascii() and s[:-4].isalpha() and s.islower()]
    for _ in range(4000):
        a, b = rnd.choice(starts), rnd.choice(ends)
        ids = t.encode(a + b[:-4], add_special_tokens=False).ids
        assert w.word_ids(a + b[:-4]) == ids
        assert w.compatible(w.vocab[a], w.vocab[b]) == (ids == [w.vocab[a], w.vocab[b]])


def test_packing(docs):
    places = packing.pack(docs, WORD, with_ids=True).cache()
    rows = places.collect()
    by_doc, want = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), Counter()
    for r in docs.collect():
        ids = [*library(WORD, r["text"]), 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[(r["doc_id"], k, at, len(part), crc(part))] += 1
    assert by_doc == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(sequences) == -(-sum(r["length"] for r in rows) // 4096)
    whole = packing.sequences(places).collect()
    assert sum(len(r["ids"]) for r in whole) == 4 * sum(r["length"] for r in rows)


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once_and_fills_gaps(seed):
    rnd = random.Random(seed)
    lengths = [min(64, 1 + int(rnd.expovariate(1 / 25))) for _ in range(3000)]
    counts = Counter(lengths)
    patterns = packing.plan(counts, 64)
    used = Counter()
    for pattern, times in patterns:
        assert times > 0 and sum(x * n for x, n in pattern.items()) <= 64
        for x, n in pattern.items():
            used[x] += n * times
    assert used == counts
    assert sum(t for _, t in patterns) <= -(-sum(lengths) // 64) * 1.02 + 1


def test_plan_finds_exact_triples():
    assert sum(t for _, t in packing.plan({60: 5, 20: 5, 13: 5, 7: 5}, 100)) == 5


def test_code_lengths_are_optimal_and_limited():
    import heapq

    rnd = np.random.default_rng(1)
    counts = rnd.zipf(1.3, 400).clip(0, 10**6)
    counts[::7] = 0
    lengths = huffman.code_lengths(counts)
    assert ((lengths > 0) == (counts > 0)).all() and lengths.max() <= 16
    assert sum(0.5 ** int(x) for x in lengths[lengths > 0]) <= 1
    heap = [(int(c), i, 0) for i, c in enumerate(counts) if c]
    heapq.heapify(heap)
    cost, depth_free = 0, len(counts)
    while len(heap) > 1:  # cost without a limit
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        depth_free += 1
        heapq.heappush(heap, (a[0] + b[0], depth_free, 0))
    assert cost <= (lengths.astype(int) * counts).sum() <= cost * 1.02
    flat = huffman.code_lengths(1 << np.arange(30).astype(np.int64))
    assert flat.max() <= 16 and sum(0.5 ** int(x) for x in flat) <= 1


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 5000])
def test_code_round_trip(n):
    rnd = np.random.default_rng(n)
    counts = np.zeros(50_257, np.int64)
    ids = rnd.zipf(1.2, n).clip(0, 50_256)
    np.add.at(counts, ids, 1)
    code = huffman.Code(huffman.code_lengths(counts))
    blocks = [ids[: n // 3], ids[n // 3 :]]
    packed = [code.encode(b) for b in blocks]
    got = code.decode([p for p, _ in packed], [o for _, o in packed], np.array([len(b) for b in blocks]))
    assert [g.tolist() for g in got] == [b.tolist() for b in blocks]


def test_token_files(docs):
    rows = huffman.read(huffman.write(docs, BYTE), with_ids=True).collect()
    want = Counter()
    for r in docs.collect():
        ids = [*library(BYTE, r["text"]), 2]
        want[(r["doc_id"], len(ids), crc(ids))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    end = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == end and len(r["ids"]) == 4 * r["n_tokens"]
        end += r["n_tokens"]
    ordered = [-1 if r["doc_id"] is None else r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert ordered == sorted(ordered)


def test_empty_tables(docs):
    none = docs.limit(0)
    assert packing.pack(none, WORD).collect() == []
    assert huffman.round_trip(none, BYTE).collect() == []
    assert bpe.encoded(none, WORD).collect() == []
