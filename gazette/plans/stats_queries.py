"""Queries over statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.operators import stats
from gazette.plans.listing_queries import PUBLIC, public
from gazette.plans.registry import query
from gazette.plans.views import AS_OF, Views


def _n(condition: str, name: str) -> str:
    return f"count(*) FILTER ({condition}) AS {name}"


@query("d1_platform", f"""SELECT * FROM (SELECT count(*) AS users_total, {_n("status = 'active'", "users_active")}, {_n("email_verified", "users_verified")}, {_n(f"created_at::DATE = DATE '{AS_OF[:10]}'", "users_new_today")} FROM users),
(SELECT {_n("status = 'published'", "published")}, {", ".join(_n(f"status = 'published' AND type = '{t}'", f"published_{t}") for t in ("job", "result", "admit_card", "answer_key"))}, {_n("sponsored", "sponsored")} FROM content_items),
(SELECT count(*) AS saved_items FROM saved_items), (SELECT count(*) AS followed_organizations FROM followed_organizations), (SELECT count(*) AS followed_categories FROM followed_categories), (SELECT count(*) AS total_searches FROM search_events),
(SELECT {", ".join(_n(f"status = '{s}'", f"notifications_{s}") for s in ("sent", "pending", "failed"))} FROM notifications),
(SELECT sum(amount)::DOUBLE AS revenue_total, {", ".join(f"(sum(amount) FILTER (revenue_type = '{t}'))::DOUBLE AS revenue_{t}" for t in ("advertising", "subscription", "sponsored"))} FROM revenue_records)""")
def _(v: Views) -> DataFrame:
    out = stats.platform(v.users, v.content_items, v.saved_items, v.followed_organizations, v.followed_categories, v.search_events, v.notifications, v.revenue_records, AS_OF)
    return out.withColumns({c: F.col(c).cast("double") for c in out.columns if c.startswith("revenue_")})


@query("d2_popular", PUBLIC + "SELECT organization_id, organization_name, count(*) AS n FROM public WHERE organization_id IS NOT NULL GROUP BY ALL ORDER BY n DESC, organization_id LIMIT 8")
def _(v: Views) -> DataFrame:
    return stats.popular(public(v), "organization_id", "organization_name")


@query("d3_organization_directory", "SELECT o.id, o.name, count(i.id) FILTER (i.type = 'job') AS jobs, count(i.id) AS total FROM organizations o LEFT JOIN content_items i ON i.organization_id = o.id AND i.status = 'published' WHERE o.status = 'active' GROUP BY ALL")
def _(v: Views) -> DataFrame:
    live = v.content_items.where("status = 'published'")
    return stats.directory(v.organizations.where("status = 'active'").select("id", "name"), live, "organization_id", jobs=F.col("type") == "job", total=F.lit(True))


@query("d4_source_rollup", "SELECT s.id, coalesce(r.crawls, 0) AS crawls, coalesce(r.discovered, 0)::BIGINT AS discovered, coalesce(p.pages, 0) AS pages, coalesce(p.pages_changed, 0) AS pages_changed FROM sources s LEFT JOIN (SELECT source_id, count(*) AS crawls, sum(discovered) AS discovered FROM crawl_logs GROUP BY 1) r ON r.source_id = s.id LEFT JOIN (SELECT concat('src', page_id % 20) AS source_id, count(*) AS pages, count(*) FILTER (page_id % 10 = 8) AS pages_changed FROM page_paths GROUP BY 1) p ON p.source_id = s.id")
def _(v: Views) -> DataFrame:
    pages = v.page_paths.selectExpr("concat('src', page_id % 20) as source_id", "case when page_id % 10 = 8 then 'UPDATED' else 'UNCHANGED' end as last_status")
    return stats.source_rollup(v.sources, v.crawl_logs, pages)


_USAGE = "count(*) AS requests, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, count(*) FILTER (status = 'success') AS succeeded, count(*) FILTER (status = 'failed') AS failed, round(avg(duration_ms), 6) AS mean_ms"


@query("d5_ai_usage", f"SELECT operation, {_USAGE} FROM ai_generations WHERE created_at >= date_trunc('month', TIMESTAMP '2024-01-30') GROUP BY operation")
def _(v: Views) -> DataFrame:
    return stats.ai_usage(v.ai_generations, F.date_trunc("month", F.lit("2024-01-30").cast("timestamp")), "operation")


@query("d6_crawl_metrics", "SELECT count(*) AS runs, coalesce(sum(new_items), 0)::BIGINT AS new_items, coalesce(sum(updated_items), 0)::BIGINT AS updated_items, coalesce(sum(errors), 0)::BIGINT AS errors, coalesce(sum(documents_found), 0)::BIGINT AS documents_found FROM crawl_logs WHERE date_trunc('day', started_at) = TIMESTAMP '2024-01-20'")
def _(v: Views) -> DataFrame:
    return stats.crawl_metrics(v.crawl_logs, F.lit("2024-01-20").cast("timestamp"))


@query("d7_revenue", "SELECT coalesce(revenue_type, 'total') AS revenue_type, sum(amount)::DOUBLE AS amount FROM revenue_records GROUP BY ROLLUP (revenue_type)")
def _(v: Views) -> DataFrame:
    return stats.revenue(v.revenue_records).withColumn("amount", F.col("amount").cast("double"))


@query("d8_search_analytics", "SELECT lower(trim(query)) AS query, count(*) AS hits, arg_max(results_count, (ts, event_id)) AS last_results, max(ts) AS last_seen FROM search_events WHERE length(lower(trim(query))) BETWEEN 2 AND 80 GROUP BY 1")
def _(v: Views) -> DataFrame:
    return stats.search_analytics(v.search_events)


@query("d9_status_board", "SELECT status, count(*) AS n, count(*) FILTER (created_at::DATE = DATE '2024-01-15') AS today FROM notifications GROUP BY status")
def _(v: Views) -> DataFrame:
    return stats.board(v.notifications, "2024-01-15")


@query("d10_health", """WITH s AS (SELECT CASE WHEN f = 0 THEN 'healthy' WHEN f < 3 THEN 'degraded' ELSE 'unhealthy' END AS crawler FROM (SELECT count(*) FILTER (consecutive_failures >= 3) AS f FROM sources)),
m AS (SELECT CASE WHEN count(*) FILTER (status = 'failed') < 10 THEN 'healthy' ELSE 'degraded' END AS email FROM notifications)
SELECT 'crawler' AS service, crawler AS status FROM s UNION ALL SELECT 'email', email FROM m UNION ALL SELECT 'cron', 'healthy'
UNION ALL SELECT 'overall', CASE WHEN crawler = 'unhealthy' THEN 'unhealthy' WHEN crawler = 'degraded' OR email = 'degraded' THEN 'degraded' ELSE 'healthy' END FROM s, m""")
def _(v: Views) -> DataFrame:
    return stats.health(v.sources, v.notifications, v.crawl_logs)


_COUNTS = "SELECT g.slug, g.min_content_threshold, g.is_indexable, (SELECT count(*) FROM public p WHERE CASE WHEN g.kind = 'qualification' THEN contains(lower(p.qualification), lower(g.term)) ELSE contains(lower(concat_ws(chr(10), p.title, p.organization_name, p.post_name)), lower(g.term)) END) AS n FROM programmatic_pages g"


_AUDITED = _COUNTS.replace("p.title, p.organization_name, p.post_name", "p.title, p.organization_name")
_MATCHES = _COUNTS.replace("SELECT g.slug, g.min_content_threshold, g.is_indexable, (SELECT count(*) FROM public p WHERE ", "SELECT g.slug, p.id, row_number() OVER (PARTITION BY g.slug ORDER BY p.published_at DESC NULLS LAST, p.created_at DESC NULLS LAST, p.id) AS r FROM programmatic_pages g JOIN public p ON ").replace(") AS n FROM programmatic_pages g", "")


@query("c7_landing_matches", PUBLIC + f"SELECT slug, n FROM ({_COUNTS})")
def _(v: Views) -> DataFrame:
    return stats.landing_counts(v.programmatic_pages, public(v)).select("slug", "n")


@query("d11_content_audit", PUBLIC + f""", base AS (SELECT count(*) AS items, count(*) FILTER (organization_id IS NULL AND category_id IS NULL) AS orphans, count(*) FILTER (trim(coalesce(title, '')) = '') AS missing_titles, count(*) FILTER (k % 40 = 0) AS missing_descriptions, count(*) FILTER (coalesce(slug, '') = '') AS missing_canonicals FROM public),
dup AS (SELECT count(*) AS duplicate_titles FROM (SELECT lower(trim(title)) FROM public GROUP BY 1 HAVING count(*) > 1)), thin AS (SELECT count(*) FILTER (n < min_content_threshold) AS thin_pages FROM ({_AUDITED}))
SELECT *, 0::BIGINT AS broken_links, greatest(0, 100 - least(20, missing_titles * 5) - least(15, missing_descriptions * 2) - least(15, duplicate_titles * 3) - least(10, orphans * 2) - least(10, thin_pages * 2)) AS score FROM base, dup, thin""")
def _(v: Views) -> DataFrame:
    return stats.content_audit(public(v).withColumn("meta_description", F.expr("case when k % 40 <> 0 then title end")), v.programmatic_pages)


@query("h13_landing_pages", PUBLIC + f"SELECT slug, least(n, 30) AS shown, is_indexable AND least(n, 30) >= min_content_threshold AS indexable FROM ({_COUNTS})")
def _(v: Views) -> DataFrame:
    return stats.landing_pages(v.programmatic_pages, public(v))


@query("h13_landing_items", PUBLIC + f", m AS ({_MATCHES}), lists AS (SELECT slug, string_agg(id, ',' ORDER BY r) AS items, count(*) AS shown FROM m WHERE r <= 30 GROUP BY slug) SELECT g.slug, coalesce(items, '') AS items, coalesce(shown, 0)::BIGINT AS shown, is_indexable AND coalesce(shown, 0) >= min_content_threshold AS indexable FROM programmatic_pages g LEFT JOIN lists USING (slug)")
def _(v: Views) -> DataFrame:
    out = stats.landing_items(v.programmatic_pages, public(v))
    return out.select("slug", F.array_join("items", ",").alias("items"), "shown", "indexable")


_MANY = "many AS (SELECT DISTINCT 'search' AS kind, right(slug, 4) AS term FROM content_items)"


@query("c7_many_landing_pages", PUBLIC + f", {_MANY} SELECT term AS slug, count(p.id) AS n FROM many LEFT JOIN public p ON contains(lower(concat_ws(chr(10), p.title, p.slug)), lower(term)) GROUP BY term")
def _(v: Views) -> DataFrame:
    """More pages than one row should hold: their terms meet the items by grams."""
    pages = v.sql(f"WITH {_MANY} SELECT * FROM many").withColumn("slug", F.col("term"))
    return stats.landing_counts(pages, public(v).withColumn("own", F.col("slug")), ("title", "own")).select("slug", "n")


@query("d11_duplicate_titles", PUBLIC + ", t AS (SELECT lower(trim(title)) AS title, slug, row_number() OVER (PARTITION BY lower(trim(title)) ORDER BY slug) AS r FROM public WHERE lower(trim(title)) <> '') SELECT title, count(*) AS n, string_agg(slug, ',' ORDER BY r) FILTER (r <= 100) AS slugs FROM t GROUP BY title HAVING count(*) > 1")
def _(v: Views) -> DataFrame:
    return stats.duplicate_title_slugs(public(v)).select("title", "n", F.array_join("slugs", ",").alias("slugs"))


@query("d12_run_summary", """SELECT *, CASE WHEN error = 0 THEN 'completed' WHEN error < discovered THEN 'partial' ELSE 'failed' END AS status FROM (
SELECT user_id AS execution_id, count(*) AS discovered, count(*) FILTER (event_type = 'view') AS new, count(*) FILTER (event_type = 'click') AS updated, count(*) FILTER (event_type NOT IN ('view', 'click', 'error')) AS unchanged, count(*) FILTER (event_type = 'error') AS error FROM {events} GROUP BY user_id)""")
def _(v: Views) -> DataFrame:
    pages = v.raw("events").selectExpr("user_id as execution_id", "case event_type when 'view' then 'NEW' when 'click' then 'UPDATED' when 'error' then 'ERROR' else 'UNCHANGED' end as page_status")
    return stats.run_summary(pages)


@query("d14_user_dashboard", "SELECT id, (SELECT count(*) FROM saved_items s WHERE s.user_id = u.id) AS saved, (SELECT count(*) FROM followed_organizations s WHERE s.user_id = u.id) AS followed_organizations, (SELECT count(*) FROM followed_categories s WHERE s.user_id = u.id) AS followed_categories, (SELECT count(*) FROM notifications s WHERE s.user_id = u.id AND read_at IS NULL) AS unread FROM users u")
def _(v: Views) -> DataFrame:
    return stats.user_dashboard(v.users, v.saved_items, v.followed_organizations, v.followed_categories, v.notifications)


@query("d15_taxonomy", "SELECT c.id, c.name, c.sort_order, (SELECT count(*) FROM content_items i WHERE i.category_id = c.id) AS items FROM categories c ORDER BY sort_order")
def _(v: Views) -> DataFrame:
    return stats.directory(v.categories.select("id", "name", "sort_order"), v.content_items, "category_id", items=F.lit(True)).orderBy("sort_order")


@query("h12_integrity", """SELECT 'status' AS "check", count(*) AS violations FROM content_items WHERE status NOT IN ('published', 'draft', 'archived') UNION ALL SELECT 'saved_item', count(*) FROM saved_items WHERE content_item_id NOT IN (SELECT id FROM content_items WHERE status = 'published')
UNION ALL SELECT 'organization', count(*) FROM content_items WHERE organization_id IS NOT NULL AND organization_id NOT IN (SELECT id FROM organizations WHERE status = 'active') UNION ALL SELECT 'unique_title', count(*) FROM (SELECT title, type FROM content_items GROUP BY ALL HAVING count(*) > 1)""")
def _(v: Views) -> DataFrame:
    items = v.content_items
    return stats.integrity({
        "status": stats.outside(items, "status", ["published", "draft", "archived"]), "saved_item": stats.dangling(v.saved_items, "content_item_id", items.where("status = 'published'")),
        "organization": stats.dangling(items, "organization_id", v.organizations.where("status = 'active'")), "unique_title": stats.repeated(items, "title", "type"),
    })
