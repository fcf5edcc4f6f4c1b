"""Literal cases of the operators that SQL doesn't cover, edge cases, and invariants."""

import datetime as dt
import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gazette.functions import exprs, text
from gazette.operators import resolve, verify
from gazette.sources import feeds
from gazette.streaming import streams

AS_OF = "2026-07-15 00:00:00"


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "url,want",
    [
        ("HTTPS://EXAMS.GOV.IN/exams/nda-2026/?utm_source=feed&b=2&a=1#top", "https://exams.gov.in/exams/nda-2026?a=1&b=2"),
        ("http://a.example.org:80/", "http://a.example.org/"),
        ("https://a.example.org:8443/x/", "https://a.example.org:8443/x"),
        ("not a url#frag", "not a url"),
        ("http://[bad", "http://[bad"),
    ],
)
def test_normalized_url(url, want):
    assert text.normalized_url(url) == want


def test_resolved_url():
    assert text.resolved_url("../b.pdf", "https://a.example.org/x/y/") == "https://a.example.org/x/b.pdf"
    for link in ("javascript:void(0)", "mailto:a@b.c", "#top", "", "ftp://x/y"):
        assert text.resolved_url(link, "https://a.example.org/") is None


def test_masked_json():
    assert text.masked_json('{"user":"a","Password":"x","deep":[{"api_key":1,"ok":2}]}') == '{"user":"a","Password":"***","deep":[{"api_key":"***","ok":2}]}'
    assert text.masked_json("no json") == "no json"


def test_with_links():
    body = "See [SSC CGL](/old) and SSC CGL, NTPC, SSC CGL."
    assert text.with_links(body, [("SSC CGL", "/a"), ("NTPC", "/b"), ("PO", "/c")]) == "See [SSC CGL](/old) and [SSC CGL](/a), [NTPC](/b), SSC CGL."


def test_decomposed_text(spark):
    assert one(spark, text.normalize_any_text(F.col("a")), a="Résumé  — “X”") == "re sume - x"


def test_fingerprint_ignores_scripts_clocks_and_counters(spark):
    page = "<html><script>var a={}</script><p>Notice</p> Page Hits: {} 10:{}:05 AM</html>"
    a, b = (one(spark, exprs.fingerprint(F.col("a")), a=page.format("{}", n, n + 10)) for n in (1, 22))
    assert a == b
    assert one(spark, exprs.clean_content(F.col("a")), a="<script>" + "<" * 20_000 + "</script>x") == "x"


def test_long_metadata_is_masked_whole(spark):
    rows = {"note": "x" * 3000, "password_salt": "a", "deep": [{"Bearer": "b", "ok": 1}], "last": "end"}
    got = one(spark, text.mask_secrets(F.col("m")), m=json.dumps(rows))
    assert json.loads(got) == rows | {"password_salt": "***", "deep": [{"Bearer": "***", "ok": 1}]}
    assert one(spark, text.mask_secrets(F.col("m")), m='{"salt":"a"}') == '{"salt":"***"}'
    assert one(spark, text.cut_message(F.col("m")), m="y" * 1500) == "y" * 1000


def test_exam_names_and_numbers(spark):
    norm = exprs.normalize_text(F.col("a"))
    # "group d" and then "level 1" are replaced, so the name compounds; both sides of a pair do so alike
    assert one(spark, exprs.recruitment_name(norm), a="Group D posts") == "group d group d level 1 posts"
    assert one(spark, exprs.notice_number(F.col("a")), a="Advt. No. 05/2026") == "05/2026"
    assert one(spark, exprs.year_in(F.col("a")), a="CGL 2026") == 2026


IDENTITY = "id string, type string, title string, organization string, recruitment_name string, advertisement_number string, notification_number string, vacancy string, application_start string, application_last_date string, official_notification_url string, document_checksum string, created_at timestamp"


def notice(id_, type_="job", title="SSC CGL Recruitment 2026", advt=None, vacancy=None, ends=None, checksum=None, at=1):
    return (id_, type_, title, None, None, advt, None, vacancy, None, ends, None, checksum, dt.datetime(2026, 1, at))


@pytest.mark.parametrize(
    "a,b,want",
    [
        (notice("a", advt="05/2026"), notice("b", advt="Advt No 05/2026"), (98, "EXACT", "link_to_canonical")),
        (notice("a", checksum="z"), notice("b", checksum="z"), (100, "EXACT", "link_to_canonical")),
        (notice("a"), notice("b"), (100, "EXACT", "link_to_canonical")),
        (notice("a", vacancy="100"), notice("b", vacancy="200"), (90, "HIGH_CONFIDENCE", "review_required")),
        (notice("a"), notice("b", title="SSC CGL Recruitment 2025"), (0, "WEAK", "create_unique")),
        (notice("a"), notice("b", title="SSC CHSL Recruitment 2026"), (0, "WEAK", "create_unique")),
        (notice("a"), notice("b", type_="result"), (0, "WEAK", "link_related_stage")),
    ],
)
def test_pair_scores(spark, a, b, want):
    ids = resolve.identities(spark.createDataFrame([a, b], IDENTITY), AS_OF)
    left, right = (ids.where(F.col("id") == x).select([F.col(c).alias(f"{s}_{c}") for c in ids.columns]) for s, x in (("a", "a"), ("b", "b")))
    r = resolve.scored(left.crossJoin(right)).first()
    # equal titles, organization, recruitment and year make 105 before the bounds; a vacancy conflict takes 15
    assert (r["confidence"], r["tier"], r["action"]) == want


def test_blocked_audit_is_the_brute_force_audit(spark):
    orgs, exams = ["SSC", "UPSC", "RRB", "Some board"], ["CGL", "NTPC", "PO", ""]
    rows = [notice(f"n{i:02d}", ["job", "result"][i % 2], f"{orgs[i % 4]} {exams[i // 4 % 4]} Recruitment {2025 + i % 2}", advt=f"{i % 5}/2026" if i % 3 == 0 else None, vacancy=str(i % 3 * 10), checksum="c" if i % 17 == 0 else None) for i in range(60)]
    df = spark.createDataFrame(rows, IDENTITY)
    ids = resolve.identities(df, AS_OF)
    a, b = ([F.col(c).alias(f"{s}_{c}") for c in ids.columns] for s in "ab")
    every = resolve.scored(ids.select(a).crossJoin(ids.select(b)).where("a_id < b_id")).where("confidence >= 65")
    got = resolve.duplicate_audit(df, AS_OF)
    key = lambda x: sorted((r["a_id"], r["b_id"], r["confidence"]) for r in x.collect())
    assert key(got) == key(every) and key(got)


def test_merge_loses_no_source_and_rejects_self(spark):
    items = spark.createDataFrame([("a", "job", "s-a", "published", "unique", None, "n1", None), ("b", "job", "s-b", "published", "unique", "07/2026", None, "c"), ("c", "job", "s-c", "draft", "unique", None, None, None)], "id string, type string, slug string, status string, duplicate_status string, advertisement_number string, notification_number string, document_checksum string")
    sources = spark.createDataFrame([("a", "u1"), ("b", "u2"), ("b", "u1"), ("c", "u3")], "item_id string, url string")
    out = resolve.merge(items, sources, spark.createDataFrame([("a", "b"), ("c", "c")], "canonical_id string, duplicate_id string"), AS_OF)
    got = {r["id"]: r for r in out["items"].collect()}
    assert got["b"]["status"] == "archived" and got["a"]["advertisement_number"] == "07/2026" and got["a"]["notification_number"] == "n1" and got["c"]["duplicate_group_id"] is None
    assert {r["url"] for r in out["sources"].collect()} == {"u1", "u2", "u3"}
    assert [(r["from_path"], r["to_path"]) for r in out["redirects"].collect()] == [("/jobs/s-b", "/jobs/s-a")]
    assert out["audit"].count() == 1


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "k string, n long, v string")
    new = spark.createDataFrame([("b", 5, "y"), ("c", 1, "z")], "k string, n long, v string")
    once = resolve.upsert(old, new, ["k"], {"v": F.coalesce("old_v", "new_v")})
    twice = resolve.upsert(once, new, ["k"], {"v": F.coalesce("old_v", "new_v")})
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("a", 1, "x"), ("b", 5, "y"), ("c", 1, "z")]


def test_feeds(spark):
    rss = '<rss><channel><title>T</title><item><title><![CDATA[A & B]]></title><link>https://a/1</link><description>d</description><pubDate>x</pubDate></item><item><title>C</title><enclosure url="https://a/2.pdf"/></item><item><title>none</title></item></channel></rss>'
    atom = '<feed><entry><title>E</title><link href="https://a/3"/><updated>u</updated></entry></feed>'
    got = feeds.feed_items(spark.createDataFrame([("r", rss), ("a", atom), ("n", None)], "source_id string, body string")).orderBy("source_id", "pos").collect()
    assert [(r["source_id"], r["title"], r["link"]) for r in got] == [("a", "E", "https://a/3"), ("r", "A & B", "https://a/1"), ("r", "C", "https://a/2.pdf")]
    maps = spark.createDataFrame([("u", "<urlset><url><loc>https://a/1</loc><lastmod>2026-01-01</lastmod></url><url><loc>https://a/2</loc></url></urlset>"), ("i", "<sitemapindex><sitemap><loc>https://a/s.xml</loc></sitemap></sitemapindex>")], "source_id string, body string")
    assert {(r["source_id"], r["kind"], r["loc"], r["lastmod"]) for r in feeds.sitemap_entries(maps).collect()} == {("u", "url", "https://a/1", "2026-01-01"), ("u", "url", "https://a/2", None), ("i", "sitemap", "https://a/s.xml", None)}


def test_json_feeds(spark):
    bodies = [("root", '[{"title":"A","url":"/1"},{"name":"B"}]'), ("keyed", '{"meta":1,"results":[{"post_name":"C","pdf_url":"/c.pdf","summary":"s"}]}'), ("bad", "{oops"), ("none", None)]
    items, bad = feeds.json_items(spark.createDataFrame(bodies, "source_id string, body string"))
    assert {(r["source_id"], r["title"], r["link"]) for r in items.collect()} == {("root", "A", "/1"), ("keyed", "C", "/c.pdf")}
    assert {r["source_id"] for r in bad.collect()} == {"bad", "none"}


def test_body_formats(spark):
    rows = [("https://a/x.pdf", "text/html", "", None), ("https://a/r", "", " <?xml?><rss>", None), ("https://a/s", "", "<urlset>", None), ("https://a/j", "application/json", "x", None), ("https://a/h", "text/html", "<html>", None), ("https://a/d", "", "x", "rss")]
    got = feeds.body_format(spark.createDataFrame(rows, "url string, content_type string, body string, declared string")).select("format").collect()
    assert [r["format"] for r in got] == ["pdf", "rss", "sitemap", "json", "html", "rss"]


def test_page_facts_and_pdf_archive(spark, tmp_path):
    html = '<html><head><title> A  b </title><link rel="canonical" href="https://a/c"><meta name="description" content="d"></head><body><a href="/x.pdf"><b>P</b></a><a href="/x.pdf">again</a></body></html>'
    html3 = "<LINK href='../c/' rel='Canonical'><a class=x HREF = '?a=1'>One</a><a href='#top'>t</a><a href='mailto:x@y'>m</a><a href=\"it's\">q</a><a data-href='/no'>n</a><a href='/d/e/?utm_source=f&a=1'>Same</a>"
    pages = spark.createDataFrame([(1, "https://a/p", html), (2, None, None), (3, "http://B.org/d/e", html3)], "page_id long, url string, html string")
    r = feeds.page_facts(pages).where("page_id = 3").first()
    assert (r["title"], r["canonical_url"], r["description"]) == (None, "http://b.org/c", None)
    assert [(r["pos"], r["normalized_url"], r["anchor"]) for r in feeds.html_links(pages.where("page_id = 3")).orderBy("pos").collect()] == [(1, "http://b.org/d/e?a=1", "One"), (4, "http://b.org/d/it's", "q")]
    r = feeds.page_facts(pages).where("page_id = 1").first()
    assert (r["title"], r["canonical_url"], r["description"]) == ("A b", "https://a/c", "d")
    assert [(r["href"], r["anchor"], r["is_pdf"]) for r in feeds.html_links(pages.where("page_id < 3")).collect()] == [("/x.pdf", "P", True)]
    for name, data in (("one.pdf", b"%PDF-1 a"), ("copy.pdf", b"%PDF-1 a"), ("two.pdf", b"%PDF-1 b"), ("no.pdf", b"<html>")):
        (tmp_path / name).write_bytes(data)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    every = feeds.new_documents(files, spark.createDataFrame([], "checksum string"), "ssc", 2026).collect()
    assert len(every) == 2 and all(r["storage_path"].startswith("ssc/2026/") for r in every)
    known = spark.createDataFrame([(every[0]["checksum"],)], "checksum string")
    assert feeds.new_documents(files, known, "ssc", 2026).count() == 1


def test_parsed_responses(spark):
    rows = [("a", '```json\n{"title": "T", "vacancy": "N/A", "confidence": 3,}\n```'), ("b", "no"), ("c", None)]
    good, bad = verify.parsed_responses(spark.createDataFrame(rows, "id string, response string"))
    r = good.first()
    assert (r["id"], r["title"], r["vacancy"], r["confidence"]) == ("a", "T", None, 1.0)
    assert {x["id"] for x in bad.collect()} == {"b", "c"}


def test_dates_are_found_in_any_order_but_not_with_a_wrong_month(spark):
    found = lambda s, mode="strict": one(spark, verify.found_in(F.col("v"), verify._plain(F.col("s")), mode), v="2026-09-20", s=s)
    assert found("by 20 September 2026".replace("September", "Sep")) and found("20-09-2026") and found("Sep 20, 2026")
    assert not found("20 October 2026") and found("20 October 2026", "reference")


def test_internal_links_are_the_brute_force_links(spark):
    schema = "id string, type string, organization_id string, category_id string, post_name string, qualification string, published_at timestamp"
    posts, levels, types = ["Clerk", "Senior clerk ", None, "Officer", "", "Zonal officer"], ["12th pass", "Graduate or 12th", None, "10th"], ["job", "result", "exam", "answer_key"]
    at = lambda i: None if i % 41 == 0 else dt.datetime(2026, 1, 1) - dt.timedelta(hours=i // 2)
    rows = [(f"i{i:04d}", types[i % 4], ["a", "b", None][i % 3], f"c{i % 5}" if i % 7 else None, posts[i * i % 11 % 6], levels[i // 3 % 4], at(i)) for i in range(400)]
    # one organization with an old item that matches in all facets, behind more than sixty newer ones that match in few
    rows += [("old", "result", "o", "k", "Unique post", "Graduate", dt.datetime(2000, 1, 1)), ("new", "job", "o", "k", "Unique post", "Graduate", dt.datetime(2025, 1, 1))]
    rows += [(f"x{i:03d}", "exam", "o", "k", "Other", None, dt.datetime(2025, 6, 1)) for i in range(100)]
    public = spark.createDataFrame(rows, schema)
    as_of = "2026-01-01 00:00:00"
    a, b = (public.select([F.col(c).alias(f"{s}_{c}") for c in public.columns]) for s in "ab")
    every = a.crossJoin(b).where("a_id <> b_id").withColumn("score", verify.relationship(as_of=as_of)).where("score >= 20")
    rank = F.row_number().over(Window.partitionBy("a_id").orderBy(F.desc("score"), F.desc_nulls_last("b_published_at"), "b_id"))
    want = every.withColumn("rank", rank).where("rank <= 6").select("a_id", "b_id", "score", "rank")
    got = verify.internal_links(public, as_of)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert ("new", "old", 130, 1) in set(map(tuple, got.where("a_id = 'new'").collect()))


def test_page_changes_batch(spark):
    old = spark.createDataFrame([("s", "u1", "c1", "f1"), ("s", "u2", None, "f2")], "source_id string, normalized_url string, canonical_url string, fingerprint string")
    new = spark.createDataFrame([("s", "u1", None, "f1"), ("s", "u2", None, "g2"), ("s", "u3", "c1", "f1"), ("s", "u4", None, "f2"), ("s", "u5", None, "zz")], old.schema)
    got = {r["normalized_url"]: (r["page_status"], r["repeats_content"]) for r in streams.page_changes(old, new).collect()}
    assert got == {"u1": ("UNCHANGED", True), "u2": ("UPDATED", False), "u3": ("UNCHANGED", True), "u4": ("NEW", True), "u5": ("NEW", False)}
