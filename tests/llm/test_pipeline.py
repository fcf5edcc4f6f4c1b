"""The pipeline's stages over planted documents."""

import random

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage = "\n".join(prose(20) for _ in range(3))
    clean = {i: prose(120) + "\n" + prose(40) for i in range(60)}
    rows = dict(clean)
    near = rows[5].split(" ")
    near[70] = "changed"
    rows |= {100: rows[3], 101: " ".join(near), 102: prose(60) + "\n" + passage, 103: prose(60) + "\n" + passage, 104: "short text", 105: prose(80) + " token=abcdefgh1234", 106: None, 107: prose(5000)}
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", 0) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "best_fit_packing":
            assert docs.columns == corpus_pipeline.COLUMNS
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    assert not {104, 106} & set(seen["quality_rules"]) and set(clean) <= set(seen["quality_rules"])
    assert passage in seen["line_dedup"][102]["text"] and passage.split("\n")[1] not in seen["line_dedup"][103]["text"]
    assert not {100, 101} & set(seen["near_dedup"]) and set(clean) <= set(seen["near_dedup"])
    assert seen["secret_scans"][105]["text"].endswith(" [secret]") and seen["secret_scans"][0]["text"] == clean[0]
    assert set(seen["best_fit_packing"]) == set(seen["secret_scans"])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(seen["best_fit_packing"]) and max(r["offset"] + r["length"] for r in packed) <= 4096
