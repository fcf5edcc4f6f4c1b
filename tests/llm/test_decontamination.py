"""Decontamination against plain Python."""

import hashlib
import random
import re

import pyarrow as pa
import pytest

from gazette.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(texts, items, window):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= {str(i) for i in windows[tuple(w[k : k + n])] if i is not None}
        out.append((len(w), len(hit), sorted(found)))
    return out


def made(rnd):
    pool = [f"w{i}" for i in range(rnd.choice([2, 3, 5, 20]))] + ["É", "A", "ß　x"]
    text = lambda n: rnd.choice([" ", "-", ",\n", "\x00"]).join(rnd.choice(pool) for _ in range(rnd.randrange(n)))
    items = [(rnd.choice([None, k, k // 2]), rnd.choice([None, "", "...", text(6), text(30), text(30)])) for k in range(rnd.randrange(8))]
    return items, [rnd.choice([None, "", text(60), text(200)]) for _ in range(30)]


def test_automaton(monkeypatch):
    rnd = random.Random(5)
    for _ in range(200):
        items, texts = made(rnd)
        window = rnd.choice([3, 4, 10])
        automaton = decontamination.Automaton([(None if i is None else str(i), decontamination.words_of(t)) for i, t in items], [True] * len(items), window)
        monkeypatch.setattr(decontamination, "STEP_BYTES", rnd.choice([10, 100, 1 << 20]))
        got = [(n, sum(e - s for s, e in spans), found) for n, spans, found in decontamination._streamed(automaton, pa.array(texts, pa.string()))]
        assert got == by_hand(texts, items, window)


@pytest.mark.parametrize("shard_words", [1 << 18, 40])
def test_report_in_one_shard_and_in_many(spark, monkeypatch, shard_words):
    rnd = random.Random(6)
    pool = [f"v{i}" for i in range(300)]
    text = lambda n: " ".join(rnd.choice(pool) for _ in range(n))
    items = [(i, text(rnd.choice([3, 12, 40]))) for i in range(20)] + [(20, text(400)), (None, text(15)), (21, None), (22, "?!"), (22, text(11)), (3, text(14))]
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 25)
    texts = [None, "", "?", text(90), "V1. " * 30_000] + [text(20) + " " + t.upper() + " / " + text(9) for _, t in items if t]
    docs = [(n % 9 if n % 4 else None, t, "clash") for n, t in enumerate(texts + texts[-6:])]
    got = decontamination.report(spark.createDataFrame(docs, "doc_id long, text string, n_hit string"), spark.createDataFrame(items, "item_id long, text string"), shard_words=shard_words)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = [(d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for (d, *_), (n, h, i) in zip(docs, by_hand([t for _, t, _ in docs], items, 10), strict=True)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_empty_tables_and_cleaning(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    other = "how many red birds sat upon that very old stone wall today"
    rows = [(1, f"Before, {item.upper()}; after all of these words that nobody listed anywhere at all", 7, "x"), (2, item, 7, "x"), (3, None, 7, "x"), (4, "clean", 7, "x"), (5, f"a {other} b c d e f g h i j k l m n o p {item}!", 7, "x"), (5, "clean", 7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, spans string")
    items = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    got = decontamination.cleaned(docs, items)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "Before, ; after all of these words that nobody listed anywhere at all", 7, "x"), (3, None, 7, "x"), (4, "clean", 7, "x"), (5, "clean", 7, None)], key=str)
    assert {r["doc_id"]: r["text"] for r in decontamination.cleaned(docs, items, most_coverage=1.0).collect()}[2] == ""
    assert sorted(r["text"] or "" for r in decontamination.cleaned(docs, items, longest_span=11, most_coverage=1.0).where("doc_id = 5").collect()) == ["a  b c d e f g h i j k l m n o p !", "clean"]
    assert decontamination.report(docs, items.limit(0)).where("contaminated or n_hit <> 0").count() == 0
    assert decontamination.report(docs.limit(0), items).collect() == []
