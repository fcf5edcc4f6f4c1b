"""Statistics: platform, usage, crawl, revenue, search, status boards, health, content audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.operators.listing import newest
from gazette.operators.search import n_best, occurrences


def one_row(*parts: DataFrame) -> DataFrame:
    """Side by side, frames that are aggregates of one row each."""
    return reduce(lambda a, b: a.join(F.broadcast(b)), parts)


def platform(users: DataFrame, items: DataFrame, saved: DataFrame, organizations: DataFrame, categories: DataFrame, searches: DataFrame, notifications: DataFrame, revenue: DataFrame, as_of: str) -> DataFrame:
    """21 figures, one pass over each table."""
    live = F.col("status") == "published"
    today = F.to_date("created_at") == F.to_date(F.lit(as_of))
    count = F.count("*")
    return one_row(
        users.agg(count.alias("users_total"), F.count_if(F.col("status") == "active").alias("users_active"), F.count_if("email_verified").alias("users_verified"), F.count_if(today).alias("users_new_today")),
        items.agg(F.count_if(live).alias("published"), *[F.count_if(live & (F.col("type") == t)).alias(f"published_{t}") for t in ("job", "result", "admit_card", "answer_key")], F.count_if("sponsored").alias("sponsored")),
        saved.agg(count.alias("saved_items")),
        organizations.agg(count.alias("followed_organizations")),
        categories.agg(count.alias("followed_categories")),
        searches.agg(count.alias("total_searches")),
        notifications.agg(*[F.count_if(F.col("status") == s).alias(f"notifications_{s}") for s in ("sent", "pending", "failed")]),
        revenue.agg(F.sum("amount").cast("decimal(28,2)").alias("revenue_total"), *[F.sum(F.when(F.col("revenue_type") == t, F.col("amount"))).cast("decimal(28,2)").alias(f"revenue_{t}") for t in ("advertising", "subscription", "sponsored")]),
    )


def popular(public: DataFrame, key: str, name: str, n: int = 8) -> DataFrame:
    """The n values of key with most published items."""
    return public.where(F.col(key).isNotNull()).groupBy(key, name).agg(F.count("*").alias("n")).where("n > 0").orderBy(F.desc("n"), key).limit(n)


def directory(groups: DataFrame, rows: DataFrame, key: str, **counts: Column) -> DataFrame:
    """groups(id, ...) with counts of their items, zero kept. Counts are taken before the join."""
    n = rows.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.count_if(c).alias(name) for name, c in counts.items()])
    out = groups.join(n, F.col("id") == F.col(key), "left").drop(key)
    return out.fillna(0, list(counts))


def source_rollup(sources: DataFrame, crawls: DataFrame, pages: DataFrame) -> DataFrame:
    """Crawls, pages discovered and pages changed of each source."""
    runs = crawls.groupBy("source_id").agg(F.count("*").alias("crawls"), F.sum("discovered").alias("discovered"))
    changed = pages.groupBy("source_id").agg(F.count("*").alias("pages"), F.count_if(F.col("last_status") == "UPDATED").alias("pages_changed"))
    out = sources.select("id").join(runs, F.col("id") == F.col("source_id"), "left").drop("source_id").join(changed, F.col("id") == F.col("source_id"), "left").drop("source_id")
    return out.fillna(0)


def ai_usage(calls: DataFrame, since: Column, *by: str) -> DataFrame:
    """Requests, tokens, outcomes and mean duration of the calls from since on."""
    return calls.where(F.col("created_at") >= since).groupBy(*by).agg(
        F.count("*").alias("requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count_if(F.col("status") == "success").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.round(F.avg("duration_ms"), 6).alias("mean_ms"),
    )


def crawl_metrics(runs: DataFrame, day: Column) -> DataFrame:
    """D6."""
    total = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("new_items", "updated_items", "errors", "documents_found")]
    return runs.where(F.date_trunc("day", "started_at") == day).agg(F.count("*").alias("runs"), *total)


def revenue(records: DataFrame) -> DataFrame:
    """By type, and the grand total as type 'total', in one pass."""
    sums = records.rollup("revenue_type").agg(F.sum("amount").cast("decimal(28,2)").alias("amount"), F.grouping("revenue_type").alias("_all"))
    return sums.select(F.when(F.col("_all") == 1, "total").otherwise(F.col("revenue_type")).alias("revenue_type"), "amount")


def search_analytics(events: DataFrame) -> DataFrame:
    """Hits, last results count and last time of each normalized query of 2 to 80 characters."""
    query = F.lower(F.trim("query"))
    return events.withColumn("query", query).where(F.length("query").between(2, 80)).groupBy("query").agg(F.count("*").alias("hits"), F.max_by("results_count", F.struct("ts", "event_id")).alias("last_results"), F.max("ts").alias("last_seen"))


def board(rows: DataFrame, as_of: str, at: str = "created_at", status: str = "status") -> DataFrame:
    """Rows by status, in all and of the day."""
    return rows.groupBy(status).agg(F.count("*").alias("n"), F.count_if(F.to_date(at) == F.to_date(F.lit(as_of))).alias("today"))


def health(sources: DataFrame, notifications: DataFrame, runs: DataFrame) -> DataFrame:
    """Service, status; with the worst as service 'overall'."""
    c = sources.agg(F.count_if(F.col("consecutive_failures") >= 3).alias("failing"), F.count_if(F.col("status") == "active").alias("active"))
    n = notifications.agg(F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "pending").alias("pending"))
    r = runs.agg(F.max("started_at").alias("last_run"))
    crawler = F.when(F.col("failing") == 0, "healthy").when(F.col("failing") < 3, "degraded").otherwise("unhealthy")
    mail = F.when(F.col("failed") < 10, "healthy").otherwise("degraded")
    row = one_row(c, n, r).select(crawler.alias("crawler"), mail.alias("email"), F.lit("healthy").alias("cron"))
    worst = F.when(F.array_contains(F.array("crawler", "email", "cron"), "unhealthy"), "unhealthy").when(F.array_contains(F.array("crawler", "email", "cron"), "degraded"), "degraded").otherwise("healthy")
    return row.withColumn("overall", worst).selectExpr("stack(4, 'crawler', crawler, 'email', email, 'cron', cron, 'overall', overall) as (service, status)")


def _titled(items: DataFrame) -> DataFrame:
    return items.select(F.lower(F.trim("title")).alias("title"), "slug").where("title <> ''")


def duplicate_titles(items: DataFrame) -> DataFrame:
    """Titles of more than one item with their number."""
    return _titled(items).groupBy("title").agg(F.count("*").alias("n")).where("n > 1")


def duplicate_title_rows(items: DataFrame) -> DataFrame:
    """Every item with a repeated title, a row each, however many a title has."""
    return _titled(items).join(duplicate_titles(items), "title")


def duplicate_title_slugs(items: DataFrame, most: int = 100) -> DataFrame:
    """Titles of more than one item with their number and their first slugs, at most most as an array; duplicate_title_rows() has all."""
    first = n_best(_titled(items), ["title"], [F.asc_nulls_last("slug")], most)
    lists = first.groupBy("title").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "slug"))), lambda x: x["slug"]).alias("slugs"))
    return duplicate_titles(items).join(lists, "title")


#: Texts that a landing page of kind search looks at: as the page shows items, and as the audit counts them.
SHOWN_TEXTS, AUDITED_TEXTS = ("title", "organization_name", "post_name"), ("title", "organization_name")
#: Landing pages that may be gathered into one row and broadcast.
FEW_PAGES = 256


def landing_matches(pages: DataFrame, public: DataFrame, texts: tuple[str, ...] = SHOWN_TEXTS) -> DataFrame:
    """(slug, id) of the items that match each landing page of pages(slug, kind, term). Up to FEW_PAGES pages are gathered into one row, so that items are read once; more meet the items by the grams of their terms."""
    text = {"qualification": F.col("qualification"), "search": F.concat_ws("\n", *texts)}
    if pages.limit(FEW_PAGES + 1).count() > FEW_PAGES:
        by_kind = []
        for kind, column in text.items():
            of = pages.where((F.col("kind") == "qualification") == (kind == "qualification")).select(F.col("slug").alias("term_id"), "term")
            by_kind.append(occurrences(public.select("id", column.alias("text")), of))
        return by_kind[0].unionByName(by_kind[1]).select(F.col("term_id").alias("slug"), "id")
    rules = pages.where("term <> ''").agg(F.collect_list(F.struct("slug", "kind", F.lower("term").alias("term"))).alias("rules"))
    hit = F.filter("rules", lambda r: F.when(r["kind"] == "qualification", F.lower(text["qualification"]).contains(r["term"])).otherwise(F.lower(text["search"]).contains(r["term"])))
    return public.join(F.broadcast(rules)).select("id", F.explode(F.transform(hit, lambda r: r["slug"])).alias("slug")).select("slug", "id")


def landing_counts(pages: DataFrame, public: DataFrame, texts: tuple[str, ...] = SHOWN_TEXTS) -> DataFrame:
    """Items that match each landing page."""
    counts = landing_matches(pages, public, texts).groupBy("slug").agg(F.count("*").alias("n"))
    return pages.join(counts, "slug", "left").fillna(0, ["n"])


def content_audit(public: DataFrame, pages: DataFrame) -> DataFrame:
    """Counts of faults and a score of 100 less capped penalties."""
    blank = F.coalesce(F.trim("title"), F.lit("")) == ""
    base = public.agg(F.count("*").alias("items"), F.count_if(F.col("organization_id").isNull() & F.col("category_id").isNull()).alias("orphans"), F.count_if(blank).alias("missing_titles"), F.count_if(F.coalesce(F.trim("meta_description"), F.lit("")) == "").alias("missing_descriptions"), F.count_if(F.coalesce("slug", F.lit("")) == "").alias("missing_canonicals"))
    duplicates = duplicate_titles(public).agg(F.count("*").alias("duplicate_titles"))
    thin = landing_counts(pages, public, AUDITED_TEXTS).agg(F.count_if(F.col("n") < F.col("min_content_threshold")).alias("thin_pages"))
    #: (column, cap, points each)
    penalties = (("missing_titles", 20, 5), ("missing_descriptions", 15, 2), ("duplicate_titles", 15, 3), ("orphans", 10, 2), ("thin_pages", 10, 2))
    off = reduce(lambda a, b: a + b, [F.least(F.lit(cap), F.col(c) * each) for c, cap, each in penalties])
    return one_row(base, duplicates, thin).withColumns({"broken_links": F.lit(0).cast("long"), "score": F.greatest(F.lit(0), 100 - off)})


def landing_pages(pages: DataFrame, public: DataFrame, n: int = 30) -> DataFrame:
    """Items shown per landing page (at most n) and whether it may be indexed."""
    shown = F.least(F.col("n"), F.lit(n))
    return landing_counts(pages, public).select("slug", shown.alias("shown"), (F.col("is_indexable") & (shown >= F.col("min_content_threshold"))).alias("indexable"))


def landing_items(pages: DataFrame, public: DataFrame, n: int = 30) -> DataFrame:
    """Each landing page with its n newest items as an array of ids, how many these are, and whether it may be indexed."""
    rows = landing_matches(pages, public).join(public.select("id", "published_at", "created_at"), "id")
    top = n_best(rows, ["slug"], newest(), n)
    lists = top.groupBy("slug").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("items"))
    out = pages.join(lists, "slug", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    shown = F.size("items").cast("long")
    return out.select("slug", "items", shown.alias("shown"), (F.col("is_indexable") & (shown >= F.col("min_content_threshold"))).alias("indexable"))


def run_summary(runs: DataFrame) -> DataFrame:
    """Per execution, counts by page status and the run's status."""
    n = {s.lower(): F.count_if(F.col("page_status") == s) for s in ("NEW", "UPDATED", "UNCHANGED", "ERROR")}
    out = runs.groupBy("execution_id").agg(F.count("*").alias("discovered"), *[c.alias(k) for k, c in n.items()])
    return out.withColumn("status", F.when(F.col("error") == 0, "completed").when(F.col("error") < F.col("discovered"), "partial").otherwise("failed"))


def user_dashboard(users: DataFrame, saved: DataFrame, organizations: DataFrame, categories: DataFrame, notifications: DataFrame) -> DataFrame:
    """D14."""
    out = users.select("id")
    for name, rows in (("saved", saved), ("followed_organizations", organizations), ("followed_categories", categories), ("unread", notifications.where("read_at is null"))):
        n = rows.groupBy("user_id").agg(F.count("*").alias(name))
        out = out.join(n, F.col("id") == F.col("user_id"), "left").drop("user_id")
    return out.fillna(0)


def integrity(violations: dict[str, DataFrame]) -> DataFrame:
    """Number of offending rows of each check."""
    parts = [rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations") for name, rows in violations.items()]
    return reduce(DataFrame.unionByName, parts)


def outside(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return rows.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))


def dangling(rows: DataFrame, key: str, parents: DataFrame, parent_key: str = "id") -> DataFrame:
    return rows.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias("_parent")), F.col(key) == F.col("_parent"), "left_anti")


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


