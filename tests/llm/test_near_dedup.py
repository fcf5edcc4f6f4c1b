"""Signatures against weighted similarity, and classes against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from gazette.llm import near_dedup
from gazette.llm.components import components
from gazette.llm.dart_minhash import mix, signatures

WORDS = [f"w{i}" for i in range(3000)]


def test_signatures_agree_as_weighted_sets_do():
    weights = np.array([[1, 2, 3, 0.5, 10.0], [2, 2, 1, 0.5, 8.0]])
    want = np.minimum(*weights).sum() / np.maximum(*weights).sum()
    same = []
    for seed in range(60):
        elements = mix(np.arange(5).astype(np.uint64) + np.uint64(seed * 7919))
        a, b = signatures(np.tile(elements, 2), weights.ravel(), np.array([5, 5]), 216)
        same.append((a == b).mean())
    assert abs(np.mean(same) - want) < 0.02


@pytest.mark.parametrize("a,b,common", [(300, 280, 200), (5, 5, 4), (20_000, 20_000, 17_000), (1, 1, 1)])
def test_signatures_agree_as_sets_do(a, b, common):
    same = []
    for seed in range(30):
        e = mix(np.arange(1, a + b - common + 1).astype(np.uint64) + np.uint64(seed << 32))
        x, y = signatures(np.concatenate([e[:a], e[a - common :]]), np.ones(a + b), np.array([a, b]), 216)
        assert (x != 0).all()
        same.append((x == y).mean())
    assert abs(np.mean(same) - common / (a + b - common)) < 0.03


def test_signature_is_the_same_in_any_company():
    e = mix(np.arange(1, 901).astype(np.uint64))
    alone = signatures(e[:100], np.ones(100), np.array([100]), 64)
    among = signatures(e, np.ones(900), np.array([100, 300, 500]), 64)
    assert (alone[0] == among[0]).all()


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)]
    up = {x: x for p in pairs for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: root(x) for p in pairs if p[0] != p[1] for x in p}


def brute(rows, weighted=False):
    bags = []
    for _, text in rows:
        w = (text or "").lower().split()
        bag = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
        bags.append(bag if weighted else Counter(set(bag)))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = bags[i], bags[j]
            near = bool(a | b) and 5 * (a & b).total() >= 4 * (a | b).total()
            if near or (rows[i][1] is not None and rows[i][1] == rows[j][1]) or (rows[i][1] is None and rows[j] == rows[i]):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(rows))]


@pytest.mark.parametrize("tile", [near_dedup.TILE, 4])
def test_classes_are_those_of_brute_force(spark, tile):
    rnd = random.Random(4)
    text = lambda n: [rnd.choice(WORDS) for _ in range(n)]
    rows = [(1, None), (2, None), (3, ""), (4, ""), (5, " \n"), (6, "one"), (7, "ONE "), (8, "a b c d"), (9, "a b c d e f"), (10, "\x001"), (11, "i1"), (12, "1")]
    passage = text(40)
    for base in range(12):
        words = text(rnd.choice([30, 80, 200, 2000]))
        for copy in range(rnd.choice([1, 2, 6, 20])):
            w = list(words)
            for _ in range(int(len(w) * rnd.choice([0, 0, 0.01, 0.02, 0.04, 0.1]))):
                w[rnd.randrange(len(w))] = rnd.choice(WORDS)
            rows.append((100 * base + copy + 20, " ".join(w)))
    rows += [(5000 + i, " ".join(passage + text(60))) for i in range(25)]
    rows += [rows[-1], rows[-1], (None, rows[20][1]), (None, "quite alone here"), (None, None)]
    rnd.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x", b"k") for i, t in rows], "doc_id long, text string, class_id string, key binary").repartition(3)
    got = [(r["doc_id"], r["class_id"]) for r in near_dedup.classes(docs, tile).collect()]
    roots = brute(rows)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    assert Counter(got) == Counter((i, least.get(r)) for (i, _), r in zip(rows, roots, strict=True))
    kept = near_dedup.deduped(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {least.get(r) for r in roots}


@pytest.mark.parametrize("pivots", [1, 3])
def test_large_buckets_lose_no_link(spark, monkeypatch, pivots):
    """Clusters whose members are linked to few of their own, beside others that nearly are and strangers, in one bucket of many tiles."""
    monkeypatch.setattr(near_dedup, "PIVOTS", pivots)
    rnd = random.Random(8)
    sets = []
    for cluster, n in ((0, 90), (1, 60), (2, 10)):
        base = list(range(1000 * cluster, 1000 * cluster + 100)) if cluster < 2 else [*range(40), *range(5000, 5060)]
        for k in range(n):
            edits = rnd.choice([0, 2, 5, 9, 12, 16, 25])
            if k % 7 == 3:  # drifting away step by step
                base = [x if rnd.random() > 0.06 else rnd.randrange(10**6) for x in base]
            sets.append(sorted({x if rnd.random() > edits / 100 else rnd.randrange(10**6) for x in base}))
    sets += [sorted({rnd.randrange(10**6) for _ in range(50)}) for _ in range(20)]
    arrays = [np.array(x, np.uint64) for x in sets]
    keys = [bytes([i]) for i in range(len(sets))]
    members = spark.createDataFrame([(b, k, len(x)) for b in (1, 2) for k, x in zip(keys, sets, strict=True) if b == 1 or k[0] % 3], "bucket long, key binary, size long")
    rows = spark.createDataFrame([(k, x.tobytes()) for k, x in zip(keys, arrays, strict=True)], "_key binary, elements binary")
    forest = near_dedup._Forest(len(sets))
    for r in near_dedup.linked(members, rows, tile=8).collect():
        u, v = r["u"][0], r["v"][0]
        common = len(set(sets[u]) & set(sets[v]))
        assert common * 5 >= (len(sets[u]) + len(sets[v]) - common) * 4
        forest.link(u, v)
    want = near_dedup._Forest(len(sets))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            common = len(set(a) & set(b))
            if common * 5 >= (len(a) + len(b) - common) * 4:
                want.link(i, j)
    assert [forest.root(i) for i in range(len(sets))] == [want.root(i) for i in range(len(sets))]
    assert 5 < len({want.root(i) for i in range(len(sets))}) < 120


def test_classes_by_weights_are_those_of_brute_force(spark):
    """Repeated lines weigh as often as they occur: some texts are near by weights only, some by sets only."""
    rnd = random.Random(12)
    text = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    rows = [(1, None), (2, ""), (3, "a b c d"), (4, "A b c d")]
    for base in range(10):
        line, body = text(12), text(60)
        for copy in range(6):
            other = text(rnd.choice([4, 15, 40]))
            times = rnd.choice([1, 1, 20, 21, 60])
            rows.append((100 * base + copy + 20, rnd.choice(["{b} {r} {o}", "{r} {b}", "{r} {o}", "{b} {r}"]).format(b=body, o=other, r=" ".join([line] * times))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for weighted in (False, True):
        roots, least = brute(rows, weighted), {}
        for (i, _), r in zip(rows, roots, strict=True):
            least[r] = min(least.get(r, i), i)
        got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs, weighted=weighted).collect()}
        assert got == {i: least[r] for (i, _), r in zip(rows, roots, strict=True)}
    assert brute(rows) != brute(rows, True)


def _bucket(spark, sets):
    members = spark.createDataFrame([(1, i.to_bytes(2), len(x)) for i, x in enumerate(sets)], "bucket long, key binary, size long")
    return members, spark.createDataFrame([(i.to_bytes(2), np.array(sorted(x), np.uint64).tobytes()) for i, x in enumerate(sets)], "_key binary, elements binary")


@pytest.mark.parametrize("common", [60, 85])
def test_a_bucket_of_strangers_costs_rows_in_proportion_to_its_members(spark, monkeypatch, common):
    """All members have a frequent part in common, which isn't enough for a link; a few pairs are linked."""
    monkeypatch.setattr(near_dedup, "PAIRED_TILES", 4)
    rnd = random.Random(3)
    for n in (100, 300):
        sets = [{*range(common), *(rnd.randrange(1000, 10**9) for _ in range(100 - common))} for _ in range(n)]
        for i in range(0, 20, 2):
            sets[i + 1] = set(sorted(sets[i])[:97]) | {rnd.randrange(1000, 10**9) for _ in range(3)}
        members, rows = _bucket(spark, sets)
        dealt, found = near_dedup.dealt_groups(members, rows, 8)
        assert dealt.count() <= 4 * n
        links = {frozenset((r["u"], r["v"])) for r in near_dedup.linked(members, rows, 8).collect()}
        assert links == {frozenset((i.to_bytes(2), (i + 1).to_bytes(2))) for i in range(0, 20, 2)}


def test_finer_buckets_lose_no_link(spark):
    """Sets of many sizes around the limit of similarity: every linked pair meets in a finer bucket."""
    rnd = random.Random(5)
    sets = [set(range(k)) for k in range(1, 12)] + [{10**6 + k} for k in range(3)]
    for base in range(8):
        whole = [rnd.randrange(10**9) for _ in range(rnd.choice([5, 9, 20, 100]))]
        for _ in range(12):
            kept = rnd.sample(whole, max(1, int(len(whole) * rnd.choice([0.8, 0.85, 0.9, 1]))))
            sets.append(set(kept) | {rnd.randrange(10**9) for _ in range(rnd.choice([0, 0, 1, len(whole) // 10]))})
    members, rows = _bucket(spark, sets)
    together = {}
    for r in near_dedup.finer(members, rows).collect():
        together.setdefault(r["bucket"], set()).add(int.from_bytes(r["key"]))
    met = {(i, j) for group in together.values() for i in group for j in group if i < j}
    wanted = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and 5 * len(a & b) >= 4 * len(a | b)}
    assert wanted and wanted <= met


def test_empty(spark):
    assert near_dedup.classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_links_at_the_threshold_are_rarely_missed():
    assert (1 - 0.8**near_dedup.ROWS) ** near_dedup.BANDS < 2e-5
