"""Merge chains, classes, matching, search by grams, deep pages, typed loading, lists, sitemaps and entitlements against plain Python."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gazette.operators import alerts, listing, pages, resolve, search, stats
from gazette.sources import feeds, tables

AS_OF = "2026-07-01 00:00:00"
ITEM = "id string, type string, slug string, status string, duplicate_status string, advertisement_number string, notification_number string, document_checksum string"


def merged(spark, names, merges, sources=(), **fields):
    items = spark.createDataFrame([(n, "job", f"s-{n}", "published", "unique", fields.get(n), None, None) for n in names], ITEM)
    held = spark.createDataFrame(list(sources) or [(n, f"u-{n}") for n in names], "item_id string, url string")
    out = resolve.merge(items, held, spark.createDataFrame(merges, "canonical_id string, duplicate_id string"), AS_OF)
    return {k: v.collect() for k, v in out.items()}


def test_chains_end_at_their_root(spark):
    out = merged(spark, "abcdefgh", [("b", "a"), ("c", "b"), ("d", "c"), ("d", "e"), ("h", "g")], a="1/26", e="9/26")
    items = {r["id"]: r for r in out["items"]}
    assert {r["item_id"] for r in out["sources"]} == {"d", "f", "h"} and len(out["sources"]) == 8
    assert {i: items[i]["duplicate_group_id"] for i in "abcdefgh"} == {"a": "d", "b": "d", "c": "d", "d": "d", "e": "d", "f": None, "g": "h", "h": "h"}
    assert [items[i]["status"] for i in "abcde"] == ["archived", "archived", "archived", "published", "archived"]
    # nearest first: e is one step from d, a three
    assert items["d"]["advertisement_number"] == "9/26" and items["b"]["advertisement_number"] == "1/26" and items["c"]["advertisement_number"] is None
    assert {(r["from_path"], r["to_path"]) for r in out["redirects"]} == {(f"/jobs/s-{i}", "/jobs/s-d") for i in "abce"} | {("/jobs/s-g", "/jobs/s-h")}
    assert len(out["audit"]) == 5 and out["rejected"] == []


def test_cycles_and_other_faults_are_reported(spark):
    merges = [("b", "a"), ("c", "b"), ("a", "c"), ("a", "d"), ("d", "e"), ("f", "f"), ("none", "g"), ("g", "none"), ("h", "i"), ("g", "i"), ("h", "i"), (None, "h")]
    out = merged(spark, "abcdefghi", merges)
    assert sorted((r["canonical_id"], r["duplicate_id"], r["reason"]) for r in out["rejected"]) == [("a", "c", "cycle"), ("b", "a", "cycle"), ("c", "b", "cycle"), ("f", "f", "self"), ("g", "none", "missing"), ("h", "i", "repeated"), ("none", "g", "missing")]
    groups = {r["id"]: r["duplicate_group_id"] for r in out["items"]}
    assert groups == {"a": "a", "b": None, "c": None, "d": "a", "e": "a", "f": None, "g": "g", "h": None, "i": "g"}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests(spark, seed):
    rnd = random.Random(seed)
    names = [f"n{i:02}" for i in range(60)]
    into = {n: rnd.choice(names[:i]) for i, n in enumerate(names) if i and rnd.random() < 0.9}
    roots, cycles = resolve.merge_roots(spark.createDataFrame([(c, d) for d, c in into.items()], "canonical_id string, duplicate_id string"))
    want = {}
    for n in into:
        far, at = 0, n
        while at in into:
            at, far = into[at], far + 1
        want[n] = at, far
    assert {r["duplicate_id"]: (r["root_id"], r["distance"]) for r in roots.collect()} == want and cycles.count() == 0


NOTICE = "id string, type string, title string, organization string, recruitment_name string, advertisement_number string, notification_number string, vacancy string, application_start string, application_last_date string, official_notification_url string, document_checksum string, created_at timestamp"


def notices(spark, rows):
    names = [f.split()[0] for f in NOTICE.split(", ")]
    full = [tuple(({"type": "job"} | r).get(n) for n in names[:-1]) + (r.get("t", 0),) for r in rows]
    return spark.createDataFrame(full, NOTICE.replace("created_at timestamp", "t long")).withColumn("created_at", F.timestamp_seconds("t")).drop("t")


def best_by_hand(spark, incoming, catalogue):
    ids = [resolve.identities(x, AS_OF) for x in (incoming, catalogue)]
    a, b = ([F.col(c).alias(f"{s}_{c}") for c in resolve.IDENTITY] for s in "ab")
    out = defaultdict(list)
    for r in resolve.scored(ids[0].select(a).crossJoin(ids[1].select(b))).collect():
        number = any(r[f"a_{k}"] is not None and r[f"a_{k}"] == r[f"b_{k}"] for k in ("advt", "notif"))
        stage = 1 if number else 2 if r["a_checksum"] is not None and r["a_checksum"] == r["b_checksum"] else 3
        if stage < 3 or r["confidence"] >= 50:
            out[r["a_id"]].append((stage, -r["confidence"], -r["b_created_at"].timestamp(), r["b_id"], r["action"]))
    return {k: min(v) for k, v in out.items()}


def test_matching_loses_nothing(spark):
    """Against all pairs: titles, numbers, checksums, document URLs, dates and vacancies, with many equal and missing ones."""
    rnd = random.Random(4)
    pick = lambda *x: rnd.choice([None, *x])
    rows = [
        {"id": f"n{i:03}", "type": rnd.choice(["job", "job", "result"]), "title": rnd.choice(["SSC CGL Recruitment 2026", "SSC CGL notice 2026", "UPSC 2026 posts", "Board of works 2026 clerk wanted", "Board of works 2026 clerk", "SSC notice 2025"]), "advertisement_number": pick(None, None, "1/26", "2/26"),
         "notification_number": pick(None, None, None, "n5"), "vacancy": pick("10", "20", "30"), "application_last_date": pick("2026-08-01", "2026-09-01"), "official_notification_url": pick(None, None, "u1", "u2"), "document_checksum": pick(None, None, None, "c1"), "t": rnd.randrange(40)}
        for i in range(170)
    ]
    incoming, catalogue = notices(spark, rows[:60]), notices(spark, rows[60:])
    want = best_by_hand(spark, incoming, catalogue)
    got = {r["incoming_id"]: r for r in resolve.match_incoming(incoming, catalogue, AS_OF).collect()}
    assert {k: (r["stage"], -r["confidence"], r["match_id"], r["action"]) for k, r in got.items()} == {k: (v[0], v[1], v[3], v[4]) for k, v in want.items()}
    assert {v[0] for v in want.values()} == {1, 2, 3}


def test_matches_without_a_key_and_across_stages(spark):
    same = {"title": "Clerk wanted in the town", "vacancy": "12", "application_last_date": "2026-08-01"}
    catalogue = notices(spark, [same | {"id": "k1"}, {"id": "k2", "type": "result", "title": "Result 2026", "advertisement_number": "7/26"}, {"id": "k3", "title": "Other", "notification_number": "N-9"}])
    incoming = notices(spark, [same | {"id": "a"}, {"id": "b", "title": "A job 2026", "advertisement_number": "7/26"}, {"id": "c", "title": "Other things", "notification_number": "N-9"}, {"id": "d", "title": "Alone"}])
    got = {r["incoming_id"]: (r["match_id"], r["confidence"], r["stage"], r["action"]) for r in resolve.match_incoming(incoming, catalogue, AS_OF).collect()}
    assert got == {"a": ("k1", 55, 3, "review_required"), "b": ("k2", 0, 1, "link_related_stage"), "c": ("k3", 98, 1, "link_to_canonical")}
    with pytest.raises(ValueError, match="46 or more"):
        resolve.match_incoming(incoming, catalogue, AS_OF, least=40)


def test_classes_stand_for_their_pairs(spark):
    rows = [{"id": f"n{i}", "type": ["job", "result", "admit_card"][i % 3], "title": "SSC CGL Recruitment 2026" if i % 4 else "UPSC CDS 2026", "vacancy": str(i % 2)} for i in range(24)]
    df = notices(spark, rows)
    pairs, members = resolve.stage_classes(df, AS_OF)
    assert sum(r["a_n"] * r["b_n"] for r in pairs.collect()) == resolve.related_stages(df, AS_OF).count() and members.count() == 24
    audit, of = resolve.audit_classes(df, AS_OF)
    assert of.columns == ["id", "class"] and resolve.audit_pairs(audit).agg(F.sum("pairs")).first()[0] == resolve.duplicate_audit(df, AS_OF).count() > 0


def test_terms_by_grams_are_brute_force(spark):
    rnd = random.Random(7)
    text = lambda n: "".join(rnd.choice("abAB é%_") for _ in range(rnd.randrange(n)))
    items = [(f"i{k}", rnd.choice([None, "", text(40), text(40)])) for k in range(80)]
    terms = [(k, rnd.choice([None, "", text(3), text(5), text(8)])) for k in range(300)] + [(999, "ab"), (1000, "zzz"), (1001, "é")]
    got = search.occurrences(spark.createDataFrame(items, "id string, text string"), spark.createDataFrame(terms, "term_id long, term string"))
    want = {(k, i) for k, t in terms for i, x in items if t and x and t.lower() in x.lower()}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) and len(want) > 300
    none = spark.createDataFrame([], "term_id long, term string")
    assert search.occurrences(spark.createDataFrame(items, "id string, text string"), none).collect() == []


def test_the_first_of_a_hot_key_are_cut_before_the_shuffle(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 50).cast("string"))).alias("title"), F.concat(F.lit("s"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("slug"))
    out = stats.duplicate_title_slugs(rows, most=4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan
    hot = {r["title"]: r for r in out.collect()}["hot"]
    assert hot["n"] == 3333 and hot["slugs"] == ["s00001", "s00002", "s00004", "s00005"]
    assert stats.duplicate_title_rows(rows).count() == 5000


def test_landing_pages_by_rules_and_by_grams(spark, monkeypatch):
    public = spark.createDataFrame([(f"i{k}", f"Railway clerk {k}" if k % 2 else f"Bank {k}", "UPSC board" if k % 5 == 0 else None, None, ["10th", "Graduate"][k % 2], k, k) for k in range(60)], "id string, title string, organization_name string, post_name string, qualification string, p long, c long")
    public = public.withColumns({"published_at": F.timestamp_seconds("p"), "created_at": F.timestamp_seconds("c")})
    landing = spark.createDataFrame([("a", "search", "railWAY", 3, True), ("b", "qualification", "grad", 3, True), ("c", "search", "upsc", 30, True), ("d", "search", "none", 0, True), ("e", "search", "", 0, True)], "slug string, kind string, term string, min_content_threshold int, is_indexable boolean")
    few = sorted(map(tuple, stats.landing_items(landing, public).collect()))
    monkeypatch.setattr(stats, "FEW_PAGES", 2)
    assert sorted(map(tuple, stats.landing_items(landing, public).collect())) == few
    assert [(r[0], r[2], r[3]) for r in few] == [("a", 30, True), ("b", 30, True), ("c", 12, False), ("d", 0, True), ("e", 0, True)]
    assert few[2][1] == [f"i{k}" for k in range(55, -1, -5)]


def test_a_deep_page_reads_one_range(spark):
    rows = spark.range(10_000).select(F.concat(F.lit("i"), F.lpad(((F.col("id") * 7919) % 10_000).cast("string"), 5, "0")).alias("id"), (F.col("id") % 10).alias("kind"))
    deep = pages.Pages.of(rows, [F.desc("id")], ranges=8)
    got = deep.page(150, 50)
    assert [r["id"] for r in got.collect()] == [f"i{9999 - k:05}" for k in range(7450, 7500)]
    read = re.search(r"PartitionFilters: \[[^\]]*?_range#\d+ (?:IN \(([\d,]+)\)|= (\d+))", got._jdf.queryExecution().executedPlan().toString())
    assert len((read[1] or read[2]).split(",")) <= 2
    first = got.first()
    assert (first["total"], first["total_pages"], first["has_next"], first["has_prev"]) == (10_000, 200, True, True)
    assert deep.page(201, 50).collect() == [] and pages.Pages.of(rows.limit(0), [F.asc("id")]).page().collect() == []
    last = deep.page(200, 500)
    assert [r["id"] for r in last.collect()][-1] == "i00000" and not last.first()["has_next"]


def test_numbers_without_one_sort(spark):
    rows = spark.range(3000).select((F.col("id") % 4).alias("kind"), F.col("id").alias("v")).withColumn("kind", F.when(F.col("kind") > 0, F.col("kind")))
    got = pages.numbered(rows, [F.desc("v")], "kind").collect()
    want = {}
    for k in (0, 1, 2, 3):
        want |= {(k or None, v): n for n, v in enumerate(sorted((x for x in range(3000) if x % 4 == k), reverse=True))}
    assert {(r["kind"], r["v"]): r["number"] for r in got} == want


def test_typed_loading_keeps_bad_rows_apart(spark, tmp_path):
    raw = [("1", "2026-07-01 10:00:00", "1", "12.50", "x"), (" 2 ", "2026-07-01T10:00:00Z", "false", "", "x"), ("three", "2026-07-01", "0", "1", "x"), ("4", "yesterday", "2", "1e3", "x"), (None, "", None, None, None), ("6", None, "TRUE", "99999999999", None)]
    spark.createDataFrame(raw, "id string, at string, flag string, amount string, more string").write.parquet(str(tmp_path / "t.parquet"))
    schema = ("id long not null, at timestamp, flag boolean, amount decimal(10,2), later string")
    out = tables.load(spark, str(tmp_path), "t", schema)
    assert out.rows.schema.simpleString() == "struct<id:bigint,at:timestamp,flag:boolean,amount:decimal(10,2),later:string>"
    assert sorted((r["id"], r["flag"], r["amount"] and float(r["amount"]), r["at"].hour) for r in out.rows.collect()) == [(1, True, 12.5, 10), (2, False, None, 10)]
    assert sorted((r["reasons"] for r in out.errors.collect()), key=str) == [["amount"], ["at", "flag"], ["id"], ["id"]]
    numbers = spark.createDataFrame([(1.0, 1, 0), (1.5, 300, 5), (None, None, None)], "a double, b long, c int")
    typed = tables.fitted(numbers, "a int, b byte, c boolean")
    assert [tuple(r) for r in typed.rows.collect()] == [(1, 1, False), (None, None, None)] and typed.errors.first()["reasons"] == ["a", "b", "c"]


def test_a_clean_table_is_read_by_its_columns(spark):
    rows = tables.load(spark, "/root/testdata/sf0.001", "documents").rows.where("doc_id = 7").select("lang")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan and "EqualTo(doc_id,7)" in plan
    assert tables.load(spark, "/root/testdata/sf0.001", "documents").errors.collect() == []


def test_sitemap_of_nothing_and_of_ties(spark):
    schema = "id string, type string, slug string, organization_id string, updated_at timestamp, published_at timestamp"
    organizations = spark.createDataFrame([("o", "org", None), ("p", "none", None)], "id string, slug string, updated_at timestamp")
    landing = spark.createDataFrame([("l", True, None), ("m", False, None)], "slug string, is_indexable boolean, updated_at timestamp")
    empty = feeds.sitemap(spark.createDataFrame([], schema), organizations, landing)
    paths = {r["path"]: r for r in empty.collect()}
    assert {"/jobs", "/exams", "/states/west-bengal", "/", "/jobs/l"} <= set(paths) and "/organizations/org" not in paths and "/jobs/m" not in paths and paths["/jobs"]["lastmod"] is None
    at = lambda d: F.lit(f"2026-07-0{d} 10:00:00").cast("timestamp")
    items = spark.createDataFrame([("a", "job", "x", "o"), ("b", "job", "y", None), ("c", "scheme", "z", "p")], "id string, type string, slug string, organization_id string").withColumns({"updated_at": F.when(F.col("id") == "a", at(3)).when(F.col("id") == "b", at(5)), "published_at": at(2)})
    rows = {r["path"]: r for r in feeds.sitemap(items, organizations, landing).collect()}
    assert str(rows["/jobs"]["lastmod"]) == "2026-07-03" and str(rows["/jobs/y"]["lastmod"]) == "2026-07-05" and "/organizations/none" in rows and not any(p.endswith("/z") for p in rows)
    files = feeds.sitemap_files(feeds.sitemap(items, organizations, landing), urls=5).groupBy("file").count().collect()
    assert max(r["count"] for r in files) == 5 and {r["file"] for r in files} >= {"jobs-1", "states-1", "states-5", "static-3"}


def test_entitlements_and_digest_counts(spark):
    users = spark.createDataFrame([("u1", "active", True, True, 1), ("u2", "active", True, True, 1), ("u3", "active", False, True, 1), ("u4", "active", True, True, 2)], "id string, status string, email_verified boolean, mail_on boolean, digest int")
    subscriptions = spark.createDataFrame([("s1", "u1", "pro", "active"), ("s2", "u2", "gone", "active"), ("s3", "u4", "odd", "trialing")], "id string, user_id string, plan_id string, status string").withColumns({"period_end": F.lit(None).cast("timestamp"), "created_at": F.lit(AS_OF).cast("timestamp")})
    plans = spark.createDataFrame([("pro", '["api"]'), ("odd", "not json")], "id string, features string")
    held = alerts.subscriptions_in_force(users, subscriptions, plans, AS_OF)
    got = {r["user_id"]: (r["plan_id"], r["features"], r["is_premium"]) for r in held.collect()}
    free = ("free", list(alerts.FREE_FEATURES), False)
    assert got == {"u1": ("pro", ["api"], True), "u2": free, "u3": free, "u4": ("odd", [], True)}
    asked = spark.createDataFrame([("u1", "api"), ("u1", "save_jobs"), ("u2", "save_jobs"), ("u9", "api"), ("u2", None)], "user_id string, feature string")
    assert sorted((r["user_id"], str(r["feature"]), r["allowed"]) for r in alerts.allowed(held, asked).collect()) == [("u1", "api", True), ("u1", "save_jobs", False), ("u2", "None", False), ("u2", "save_jobs", True), ("u9", "api", False)]
    items = spark.createDataFrame([("i", "published", "o", "c")], "id string, status string, organization_id string, category_id string").withColumn("published_at", F.lit("2026-06-30 12:00:00").cast("timestamp"))
    follows = spark.createDataFrame([("u1", "o")], "user_id string, organization_id string"), spark.createDataFrame([], "user_id string, category_id string")
    assert tuple(alerts.digest_counts(items, users, *follows, AS_OF).first()) == (2, 1, 1)


def test_strict_related_items_ask_for_what_is_left(spark):
    rows = [(f"i{k}", "o" if k < 4 else None, "c" if k % 2 else None, "job", k) for k in range(12)]
    public = spark.createDataFrame(rows, "id string, organization_id string, category_id string, type string, t long").withColumns({"published_at": F.timestamp_seconds("t"), "created_at": F.timestamp_seconds("t")})
    got = defaultdict(list)
    for r in sorted(listing.related(public, strict=True).collect(), key=lambda r: r["rank"]):
        got[r["id"]].append(r["related_id"])
    newest = sorted(rows, key=lambda r: -r[4])
    for own, org, cat, kind, _ in rows:
        want = [r[0] for r in newest if org and r[1] == org and r[0] != own][:6]
        for place, value in ((2, cat), (3, kind)):
            tier = [r[0] for r in newest if value and r[place] == value and r[0] != own][: 6 - len(want)]
            want += [x for x in tier if x not in want]
        assert got[own] == want


def test_names_within_names(spark, monkeypatch):
    from gazette.operators import verify

    rnd = random.Random(3)
    names = {"".join(rnd.choice("ab ") for _ in range(rnd.randrange(1, 9))).strip() or "x" for _ in range(60)} | {"z" * 3000 + "ab", "b" + "z" * 70, "z"}
    facts = spark.createDataFrame([(n,) for n in names] + [(None,), ("ab",)], "post string")
    want = {(a, b) for a in names for b in names if a in b or b in a}
    for short in (64, 3):
        monkeypatch.setattr(verify, "SHORT_NAME", short)
        got = [tuple(r) for r in verify.containing_posts(facts).collect()]
        assert set(got) == want and len(got) == len(want)


def test_pairs_counted_by_titles_are_the_listed_ones(spark):
    rnd = random.Random(11)
    pick = lambda *x: rnd.choice([None, *x])
    rows = [
        {"id": f"n{i:03}", "type": rnd.choice(["job", "result"]), "title": rnd.choice(["SSC CGL Recruitment 2026", "SSC Recruitment 2026", "SSC PO posts 2026", "UPSC 2026 posts", "Board of works clerk"]), "advertisement_number": pick("1/26", "2/26"), "notification_number": pick(None, "n5"), "vacancy": pick("10", "20"),
         "application_last_date": pick("2026-08-01", "2026-09-01"), "official_notification_url": pick(None, "u1", "u2"), "document_checksum": pick(None, "c1"), "t": i}
        for i in range(120)
    ]
    df = notices(spark, rows)
    outcomes, members = resolve.audit_titles(df, AS_OF)
    title = {r["id"]: r["title"] for r in members.collect()}
    want = defaultdict(int)
    for r in resolve.duplicate_audit(df, AS_OF).collect():
        want[(*sorted((title[r["a_id"]], title[r["b_id"]])), r["confidence"], r["tier"], r["status"])] += 1
    got = {(*sorted((r["a_title"], r["b_title"])), r["confidence"], r["tier"], r["status"]): r["pairs"] for r in outcomes.collect()}
    assert got == want and {k[2] for k in got} > {96, 98, 100}
    assert resolve.audit_titles(df.limit(0), AS_OF)[0].collect() == []
