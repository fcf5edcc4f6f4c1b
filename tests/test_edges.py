"""Listings, alerts and statistics on empty tables, on rows of nulls, and on ties."""

import pytest
from pyspark.sql import functions as F

from gazette.operators import alerts, listing, search, stats
from gazette.plans.views import AS_OF, Views

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def schemas(spark):
    v = Views(spark, SMALL)
    return {n: getattr(v, n).schema for n in ("content_items", "jobs", "organizations", "categories", "users", "saved_items", "followed_organizations", "followed_categories", "notifications", "programmatic_pages", "subscriptions", "plans", "search_events", "revenue_records")}


@pytest.fixture(scope="module", params=["empty", "nulls"])
def tables(request, spark, schemas):
    """Every table without a row, or with one row of nulls."""
    rows = [] if request.param == "empty" else [()]

    def made(schema):
        loose = type(schema)([type(f)(f.name, f.dataType, True) for f in schema])
        return spark.createDataFrame([tuple(None for _ in loose)] if rows else [], loose)

    return {n: made(s) for n, s in schemas.items()}


def starred(t):
    return listing.star(t["content_items"], t["jobs"], t["organizations"], t["categories"], AS_OF, published_only=False)


def test_listings(tables):
    public = starred(tables)
    n = tables["content_items"].count()
    assert public.count() == n
    for rows in (
        listing.filtered(public, type="job", organization="o", category="c", qualification="q", state="s", days=7, as_of=AS_OF, text="x"), listing.state_hubs(public), listing.organization_hubs(public), listing.library(tables["saved_items"], public), listing.newest_per_type(public),
        listing.closing_soon(public, AS_OF), listing.recently_updated(public), listing.related(public), listing.related(public, strict=True), listing.review_queue(tables["content_items"]),
        search.name_hubs(public, tables["organizations"]), search.search_many(public, tables["organizations"].selectExpr("id as term_id", "name as term")),
    ):
        assert rows.collect() == []
    page = listing.page_of(public, listing.order("deadline")).collect()
    assert len(page) == n and all(r["total"] == n and not r["has_next"] for r in page)
    assert listing.browse(tables["notifications"], {"status": None}).count() == n
    assert listing.inbox(tables["notifications"], tables["content_items"]).count() <= n


def test_statistics(tables):
    public = starred(tables).withColumn("meta_description", F.lit(None).cast("string"))
    n = tables["content_items"].count()
    audit = stats.content_audit(public, tables["programmatic_pages"]).first()
    assert audit["items"] == n and audit["duplicate_titles"] == 0 and 0 <= audit["score"] <= 100
    assert stats.duplicate_titles(public).collect() == stats.duplicate_title_slugs(public).collect() == stats.duplicate_title_rows(public).collect() == []
    assert all(r["shown"] == 0 and r["items"] == [] for r in stats.landing_items(tables["programmatic_pages"], public).collect())
    assert stats.user_dashboard(tables["users"], tables["saved_items"], tables["followed_organizations"], tables["followed_categories"], tables["notifications"]).count() == n


def test_alerts(tables):
    t, follows = tables, (tables["followed_organizations"], tables["followed_categories"])
    n = t["users"].count()
    assert alerts.digests(t["content_items"], t["users"], *follows, AS_OF).collect() == []
    assert tuple(alerts.digest_counts(t["content_items"], t["users"], *follows, AS_OF).first()) == (0, 0, 0)
    held = alerts.subscriptions_in_force(t["users"], t["subscriptions"], t["plans"], AS_OF)
    assert [(r["plan_id"], r["features"]) for r in held.collect()] == [("free", list(alerts.FREE_FEATURES))] * n
    assert alerts.delivery_batch(t["notifications"], t["users"], t["content_items"]).collect() == []


def test_ties_go_to_the_id(spark):
    at = F.lit("2026-01-01 10:00:00").cast("timestamp")
    rows = spark.createDataFrame([(i, "job", "o", "c") for i in "dbca"], "id string, type string, organization_id string, category_id string").withColumns({"published_at": at, "created_at": at, "vacancy": F.lit("5"), "application_last_date": at, "organization_slug": F.lit("o")})
    for sort in ("latest", "deadline", "vacancies"):
        assert [r["id"] for r in listing.page_of(rows, listing.order(sort), limit=3).collect()] == ["a", "b", "c"]
    assert [(r["id"], r["rank"]) for r in sorted(listing.newest_per_type(rows, {"job": 2}).collect(), key=lambda r: r["rank"])] == [("a", 1), ("b", 2)]
    assert {(r["id"], r["related_id"]) for r in listing.related(rows, 1).collect()} == {("a", "b"), ("b", "a"), ("c", "a"), ("d", "a")}
