"""Whitening against numpy."""

import math
import random

import numpy as np

from gazette.llm import whitening


def by_hand(rows):
    """{length: (n, sums, eigenvalues, vectors, trace)} over the distinct whole-number vectors."""
    distinct = {tuple(math.floor(256 * float(np.float32(c))) for c in v) for _, v in rows if v and all(c is not None and math.isfinite(c) for c in v)}
    out = {}
    for dim in {len(x) for x in distinct}:
        x = np.array(sorted(t for t in distinct if len(t) == dim), np.int64)
        centred = x - x.sum(0) / len(x)
        values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
        out[dim] = len(x), [int(s) for s in x.sum(0)], values[::-1], vectors[:, ::-1], values.sum()
    return out


def held(got, rows, components=4):
    fits, by_id = by_hand(rows), {}
    for r in got:
        by_id.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    want = 0
    for i, v in rows:
        if not v or any(c is None or not math.isfinite(c) for c in v):
            continue
        n, sums, values, vectors, trace = fits[len(v)]
        x = [math.floor(256 * float(np.float32(c))) for c in v]
        for k in range(min(components, int((values > values[0] * len(v) * 2.3e-16).sum()))):
            want += 1
            along = (np.array(x) - np.array(sums) / n) @ vectors[:, k] / math.sqrt(values[k])
            r = min(by_id[i][k + 1], key=lambda r: abs(abs(r["whitened"]) - abs(along)))
            assert r["n"] == n and abs(abs(r["whitened"]) - abs(along)) < 1e-9 and abs(r["explained"] - values[k] / trace) < 1e-9
            assert any(q["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for q in by_id[i][k + 1]) and abs(r["identity_error"]) < 1e-6
    assert len(got) == want


def test_whitening(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    base = rnd.normal(size=(400, 6)) * [3, 2, 1.5, 1, 0.5, 0.2]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[5][1]) for i in range(200)] + [rows[0], rows[0], (None, rows[1][1])]
    rows += [(2000, None), (2001, [None] * 6), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (2004, []), (2005, [-0.0] * 6)]
    rows += [(3000 + i, [float(i), float(i * i % 7)]) for i in range(9)] + [(4000, [1.0] * 5)]
    rows = [(i, v) for i, v in rows]
    monkeypatch.setattr(whitening, "BLOCK_NUMBERS", 200)
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, component string, index int")
    got = whitening.whitened(df)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    held(got, rows)
    # one sign for all rows of a component
    fit = by_hand(rows)[6]
    for k in range(4):
        turn = {np.sign(r["whitened"] * ((np.floor(256 * np.float32(rows[r["vec_id"]][1]).astype(float)) - np.array(fit[1]) / fit[0]) @ fit[3][:, k])) for r in got if r["component"] == k + 1 and r["vec_id"] is not None and r["vec_id"] < 400 and abs(r["whitened"]) > 1e-6}
        assert len(turn) == 1


def test_empty_flat_and_huge(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
    rnd = random.Random(1)
    rows = [(i, [rnd.uniform(-1e15, 1e15) for _ in range(3)]) for i in range(40)]
    got = whitening.whitened(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 120 and {r["deviation"] for r in got} == {None} and max(r["identity_error"] for r in got) < 1e-6
