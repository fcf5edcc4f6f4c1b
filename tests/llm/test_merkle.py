"""The manifest against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from gazette.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        out += level[i ^ 1 : (i ^ 1) + 1]
        i >>= 1
    return out


def fold(node, levels, i):
    for level in levels[:-1]:
        other = level[i ^ 1 : (i ^ 1) + 1]
        node = digest(*(other + [node] if i & 1 else [node] + other))
        i >>= 1
    return node


def by_hand(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        trees[g] = levels_of([leaf_of(*r) for r in groups[g]])
    top = levels_of([trees[g][-1][0] for g in order])
    out = []
    for n, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            changed = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None:
                changed = (*r[:4], r[4] + 1)
            folded = fold(fold(leaf_of(*changed), trees[g], i), top, n)
            proof = digest(*siblings(trees[g], i), *siblings(top, n))
            out.append((r[0], leaf_of(*r), trees[g][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=str)


def checked(spark, rows):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"idx": F.lit("clash"), "key": F.lit(1), "group": F.lit(2), "leaf": F.lit(3)})
    got = merkle.verified(merkle.manifest(docs, claims={"n_chars": tampered}))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == by_hand(rows)


def test_manifest(spark, monkeypatch):
    rnd = random.Random(3)
    lang = lambda: rnd.choice([None, "", "de", "en", "en", "en", "é", "\U0001f600", "￮"])
    rows = [(rnd.choice([None, rnd.randrange(90), rnd.randrange(10_000)]), rnd.choice([None, "", "aé\n", "x" * rnd.randrange(3000)]), lang(), rnd.choice([None, "s"]), rnd.choice([None, 0, 5])) for _ in range(700)]
    rows += [(7, "same", "fr", "s", 4)] * 300 + [(1, "alone", "zz", None, 5)]
    checked(spark, rows)
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 1)
    checked(spark, rows[::9])


def test_small_tables(spark):
    checked(spark, [(1, None, None, None, None)])
    checked(spark, [(n, "t", "en", "s", 1) for n in range(3)])
    checked(spark, [(n, "t", f"l{n}", "s", 1) for n in range(21)])
    checked(spark, [])


def test_query_catches_tampering(spark):
    got = queries.op13_merkle_manifest(spark, "/root/testdata/sf0.001")
    wrong = {r["doc_id"] for r in got.where("not verified").collect()}
    assert wrong == {i for i in range(got.count()) if zlib.crc32(str(i).encode()) % 7 == 0}
