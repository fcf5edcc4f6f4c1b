"""Queries over listings: scans, filters, joins, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.functions import exprs
from gazette.operators import listing, search
from gazette.operators.pages import Pages
from gazette.plans.registry import query
from gazette.plans.views import AS_OF, Views
from gazette.session import written
from gazette.sources import tables

STATUS = f"""CASE WHEN type = 'result' THEN 'Result Released' WHEN type = 'admit_card' THEN 'Admit Card Released' WHEN type = 'answer_key' THEN 'Answer Key Released'
  WHEN application_last_date IS NULL AND application_start IS NULL THEN 'Notification Released' WHEN application_start > TIMESTAMP '{AS_OF}' THEN 'Upcoming'
  WHEN date_trunc('day', application_last_date) + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND < TIMESTAMP '{AS_OF}' THEN 'Application Closed'
  WHEN date_trunc('day', application_last_date) + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND <= TIMESTAMP '{AS_OF}' + INTERVAL 3 DAY THEN 'Closing Soon'
  WHEN application_last_date IS NOT NULL THEN 'Applications Open' ELSE 'Active' END"""
PUBLIC = f"""WITH public AS (
  SELECT i.*, j.post_name, j.vacancy, j.qualification, j.application_start, j.application_last_date, o.name AS organization_name, o.slug AS organization_slug, c.name AS category_name, c.slug AS category_slug, {STATUS} AS calculated_status
  FROM content_items i LEFT JOIN jobs j ON j.content_item_id = i.id LEFT JOIN organizations o ON o.id = i.organization_id LEFT JOIN categories c ON c.id = i.category_id WHERE i.status = 'published') """
LATEST = "published_at DESC NULLS LAST, created_at DESC NULLS LAST, id"
TOTALS = "(SELECT count(*) FROM hits) AS total, {page} AS page, CAST(ceil((SELECT count(*) FROM hits) / {limit}.0) AS BIGINT) AS total_pages"


def public(v: Views) -> DataFrame:
    return listing.star(v.content_items, v.jobs, v.organizations, v.categories, AS_OF)


@query("a1_typed_scan", "SELECT event_id, ts, user_id, event_type, CAST(CAST(value AS DECIMAL(18, 2)) AS DOUBLE) AS amount, event_type = 'error' AS failed FROM {events}")
def _(v: Views) -> DataFrame:
    return v.raw("events").select("event_id", "ts", "user_id", "event_type", F.col("value").cast("decimal(18,2)").cast("double").alias("amount"), (F.col("event_type") == "error").alias("failed"))


#: Events as text and flags, as logs have them: times in two forms, some of them and some numbers spoilt.
_TEXTS = """texts AS (SELECT CASE WHEN event_id % 50 = 7 THEN concat('e', event_id) ELSE concat(' ', event_id) END AS event_id, CASE WHEN event_id % 40 = 3 THEN 'yesterday' WHEN event_id % 2 = 0 THEN concat(substring(concat(ts), 1, 10), 'T', substring(concat(ts), 12, 8)) ELSE substring(concat(ts), 1, 19) END AS ts,
  CASE WHEN event_id % 30 = 11 THEN 'n/a' WHEN event_id % 30 = 12 THEN '' ELSE concat(user_id) END AS user_id, CASE WHEN event_id % 60 = 13 THEN 'maybe' WHEN event_id % 3 = 0 THEN '1' ELSE 'false' END AS failed, event_type FROM {events})"""
_LOGGED = "event_id long not null, ts timestamp, user_id long, failed boolean, event_type string, note string"


@query("a1_typed_load", f"WITH {_TEXTS} SELECT CAST(trim(event_id) AS BIGINT) AS event_id, replace(ts, 'T', ' ') AS ts, CAST(nullif(user_id, '') AS BIGINT)::VARCHAR AS user_id, failed = '1' AS failed, event_type, NULL::VARCHAR AS note FROM texts WHERE NOT starts_with(event_id, 'e') AND ts <> 'yesterday' AND user_id <> 'n/a' AND failed <> 'maybe'")
def _(v: Views) -> DataFrame:
    rows = tables.fitted(v.sql(f"WITH {_TEXTS} SELECT * FROM texts"), _LOGGED).rows
    return rows.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("user_id").cast("string").alias("user_id"), "failed", "event_type", "note")


@query("a1_quarantine", f"WITH {_TEXTS}, bad AS (SELECT list_filter([CASE WHEN starts_with(event_id, 'e') THEN 'event_id' END, CASE WHEN ts = 'yesterday' THEN 'ts' END, CASE WHEN user_id = 'n/a' THEN 'user_id' END, CASE WHEN failed = 'maybe' THEN 'failed' END], lambda x: x IS NOT NULL) AS r, event_id FROM texts) SELECT event_id, array_to_string(r, ',') AS reasons FROM bad WHERE len(r) > 0")
def _(v: Views) -> DataFrame:
    errors = tables.fitted(v.sql(f"WITH {_TEXTS} SELECT * FROM texts"), _LOGGED).errors
    return errors.select(F.get_json_object("raw", "$.event_id").alias("event_id"), F.array_join("reasons", ",").alias("reasons"))


@query("b1_public_items", PUBLIC + "SELECT id, title, type, organization_name, category_name, post_name, vacancy, calculated_status FROM public")
def _(v: Views) -> DataFrame:
    return public(v).select("id", "title", "type", "organization_name", "category_name", "post_name", "vacancy", "calculated_status")


@query("b2_category_listing", PUBLIC + f", hits AS (SELECT * FROM public WHERE type = 'job' AND category_slug = 'asia' AND qualification ILIKE '%graduate%') SELECT id, title, calculated_status, {TOTALS.format(page=1, limit=12)} FROM hits ORDER BY application_last_date ASC NULLS LAST, id LIMIT 12")
def _(v: Views) -> DataFrame:
    hits = listing.filtered(public(v), type="job", category="asia", qualification="graduate")
    return listing.page_of(hits, listing.order("deadline")).select("id", "title", "calculated_status", "total", "page", "total_pages")


@query("b3_search", PUBLIC + f", hits AS (SELECT * FROM public WHERE title ILIKE '%clerk%' OR organization_name ILIKE '%clerk%' OR post_name ILIKE '%clerk%' OR category_name ILIKE '%clerk%') SELECT id, title, calculated_status, {TOTALS.format(page=2, limit=12)} FROM hits ORDER BY {LATEST} LIMIT 12 OFFSET 12")
def _(v: Views) -> DataFrame:
    return listing.page_of(listing.filtered(public(v), text="clerk"), listing.order(), page=2).select("id", "title", "calculated_status", "total", "page", "total_pages")


@query("b4_recency", PUBLIC + f"SELECT id, published_at FROM public WHERE published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY")
def _(v: Views) -> DataFrame:
    return listing.filtered(public(v), days=7, as_of=AS_OF).select("id", "published_at")


_STATE_ROWS = ", ".join(f"('{s}')" for s in (*listing.STATES, "State", "India", "China"))


@query("b5_state_hubs", PUBLIC + f"SELECT s.state, count(*) AS total, sum((type = 'job')::INT)::BIGINT AS jobs, sum((type = 'result')::INT)::BIGINT AS results, sum((type = 'admit_card')::INT)::BIGINT AS admit_cards, sum((type = 'exam')::INT)::BIGINT AS exams FROM public JOIN (VALUES {_STATE_ROWS}) s(state) ON contains(lower(title), lower(s.state)) OR contains(lower(organization_name), lower(s.state)) GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return listing.state_hubs(public(v), (*listing.STATES, "State", "India", "China"))


#: Terms by the thousand: the ends of slugs.
_TERMS = "asked AS (SELECT DISTINCT right(slug, 4) AS term FROM content_items)"


@query("b3_search_terms", PUBLIC + f", {_TERMS} SELECT term, count(*) AS items, min(p.id) AS first_id FROM asked JOIN public p ON contains(lower(concat_ws(' ', p.title, p.slug)), lower(term)) GROUP BY term")
def _(v: Views) -> DataFrame:
    """Thousands of terms at once, over titles and slugs."""
    asked = v.sql(f"WITH {_TERMS} SELECT * FROM asked")
    hits = search.occurrences(public(v).select("id", F.concat_ws(" ", "title", "slug").alias("text")), asked.select(F.col("term").alias("term_id"), "term"))
    return hits.groupBy(F.col("term_id").alias("term")).agg(F.count("*").alias("items"), F.min("id").alias("first_id"))


@query("b3_search_many", PUBLIC + ", asked AS (SELECT n_nationkey AS q, n_name AS term FROM {nation} UNION ALL SELECT 100 + r_regionkey, lower(substring(r_name, 1, 2)) FROM {region}) SELECT q AS term_id, p.id FROM asked JOIN public p ON contains(lower(concat_ws(chr(10), p.title, p.organization_name, p.post_name, p.category_name)), lower(term))")
def _(v: Views) -> DataFrame:
    asked = v.raw("nation").selectExpr("n_nationkey as term_id", "n_name as term").unionAll(v.raw("region").selectExpr("100 + r_regionkey as term_id", "lower(substring(r_name, 1, 2)) as term"))
    return search.search_many(public(v), asked)


@query("b5_name_hubs", PUBLIC + ", hits AS (SELECT n.name, p.type FROM (SELECT DISTINCT name FROM organizations) n JOIN public p ON contains(lower(p.title), lower(n.name)) OR contains(lower(p.organization_name), lower(n.name))) SELECT name, count(*) AS total, count(*) FILTER (type = 'job') AS jobs, count(*) FILTER (type = 'result') AS results, count(*) FILTER (type = 'admit_card') AS admit_cards, count(*) FILTER (type = 'exam') AS exams FROM hits GROUP BY name")
def _(v: Views) -> DataFrame:
    return search.name_hubs(public(v), v.organizations)


@query("b6_slug_lookup", "WITH asked AS (SELECT type, slug, k % 2 = 0 AS allow_preview FROM content_items) SELECT a.type, a.slug, a.allow_preview, i.id, i.status FROM asked a LEFT JOIN content_items i ON i.type = a.type AND i.slug = a.slug AND (i.status = 'published' OR a.allow_preview)")
def _(v: Views) -> DataFrame:
    return listing.by_slug(v.content_items.selectExpr("type", "slug", "k % 2 = 0 as allow_preview"), v.content_items)


@query("b7_organization_hubs", PUBLIC + "SELECT organization_id, organization_name, organization_slug, count(*) AS total, sum((type = 'job')::INT)::BIGINT AS jobs, sum((type = 'result')::INT)::BIGINT AS results, sum((type = 'admit_card')::INT)::BIGINT AS admit_cards, sum((type = 'answer_key')::INT)::BIGINT AS answer_keys FROM public WHERE organization_id IS NOT NULL GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return listing.organization_hubs(public(v))


@query("b8_review_queue", "SELECT id, status, duplicate_status, quality_score FROM content_items WHERE status = 'review' OR verification_status = 'verification_required' OR duplicate_status = 'conflict' OR quality_score < 90 ORDER BY CASE WHEN duplicate_status = 'conflict' THEN 0 ELSE 1 END, created_at DESC, id LIMIT 50")
def _(v: Views) -> DataFrame:
    return listing.review_queue(v.content_items).select("id", "status", "duplicate_status", "quality_score")


@query("b9_browse", "SELECT id, user_id, type, status, created_at FROM notifications WHERE status = 'failed' ORDER BY created_at DESC, id LIMIT 100")
def _(v: Views) -> DataFrame:
    return listing.browse(v.notifications, {"status": "failed", "type": None}, limit=100).select("id", "user_id", "type", "status", "created_at")


@query("b10_library", PUBLIC + "SELECT user_id, count(*) AS saved, " + ", ".join(f"sum((type = '{t}')::INT)::BIGINT AS saved_{t}" for t in ("job", "result", "admit_card", "answer_key")) + " FROM saved_items s JOIN public p ON p.id = s.content_item_id GROUP BY user_id")
def _(v: Views) -> DataFrame:
    return listing.library(v.saved_items, public(v))


@query("b15_due_sources", f"""SELECT id, priority, last_checked_at FROM (
  SELECT *, CASE crawl_frequency WHEN '10m' THEN 600 WHEN '15m' THEN 900 WHEN '30m' THEN 1800 WHEN '1h' THEN 3600 WHEN 'hourly' THEN 3600 WHEN '3h' THEN 10800 WHEN '6h' THEN 21600 WHEN '12h' THEN 43200 WHEN 'weekly' THEN 604800 ELSE 86400 END AS seconds FROM sources)
  WHERE status = 'active' AND crawl_frequency <> 'manual' AND (last_checked_at IS NULL OR epoch(TIMESTAMP '{AS_OF}') - epoch(last_checked_at) >= seconds) ORDER BY priority DESC, last_checked_at ASC NULLS FIRST, id LIMIT 10""")
def _(v: Views) -> DataFrame:
    frequency = F.lower(F.trim(F.coalesce("crawl_frequency", F.lit("daily"))))
    age = F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - F.unix_timestamp("last_checked_at")
    due = v.sources.where((F.col("status") == "active") & (frequency != "manual") & (F.col("last_checked_at").isNull() | (age >= exprs.lookup(frequency, exprs.FREQUENCY_SECONDS, 86400))))
    return due.orderBy(F.desc("priority"), F.asc_nulls_first("last_checked_at"), "id").limit(10).select("id", "priority", "last_checked_at")


@query("b16_live_sponsored", f"SELECT id, title FROM content_items WHERE sponsored AND status = 'published' AND created_at <= TIMESTAMP '{AS_OF}' AND (u % 2 = 0 OR created_at + INTERVAL 14 DAY >= TIMESTAMP '{AS_OF}')")
def _(v: Views) -> DataFrame:
    rows = v.content_items.where("sponsored").selectExpr("id", "title", "created_at as starts_at", "case when u % 2 <> 0 then created_at + interval 14 days end as ends_at", "status = 'published' as active")
    return listing.live_sponsored(rows, AS_OF).select("id", "title")


@query("b17_inbox", "SELECT n.id, n.user_id, n.rank::INT AS rank, i.slug AS item_slug, i.type AS item_type, t.unread FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS rank FROM notifications) n LEFT JOIN content_items i ON i.id = n.content_item_id JOIN (SELECT user_id, sum((read_at IS NULL)::INT)::BIGINT AS unread FROM notifications GROUP BY user_id) t ON t.user_id = n.user_id WHERE n.rank <= 50")
def _(v: Views) -> DataFrame:
    return listing.inbox(v.notifications, v.content_items).select("id", "user_id", "rank", "item_slug", "item_type", "unread")


@query("c1_closing_saved", "SELECT s.user_id, i.id, j.application_last_date FROM saved_items s JOIN content_items i ON i.id = s.content_item_id JOIN jobs j ON j.content_item_id = i.id WHERE i.status = 'published'")
def _(v: Views) -> DataFrame:
    items = v.content_items.where("status = 'published'").select("id")
    return v.saved_items.join(v.jobs, "content_item_id").join(items, F.col("content_item_id") == F.col("id")).select("user_id", "id", "application_last_date")


@query("c3_on_filter", "SELECT o.id, o.name, count(i.id) AS published FROM organizations o LEFT JOIN content_items i ON i.organization_id = o.id AND i.status = 'published' GROUP BY ALL")
def _(v: Views) -> DataFrame:
    counts = v.content_items.where("status = 'published'").groupBy("organization_id").agg(F.count("*").alias("n"))
    return v.organizations.join(counts, F.col("id") == F.col("organization_id"), "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("published"))


@query("c9_correlated_counts", "SELECT u.id, (SELECT count(*) FROM saved_items s WHERE s.user_id = u.id) AS saved, (SELECT count(*) FROM notifications n WHERE n.user_id = u.id) AS notified FROM users u")
def _(v: Views) -> DataFrame:
    saved = v.saved_items.groupBy("user_id").agg(F.count("*").alias("saved"))
    notified = v.notifications.groupBy("user_id").agg(F.count("*").alias("notified"))
    out = v.users.select("id").join(saved, F.col("id") == saved["user_id"], "left").drop("user_id").join(notified, F.col("id") == notified["user_id"], "left")
    return out.select("id", F.coalesce("saved", F.lit(0)).alias("saved"), F.coalesce("notified", F.lit(0)).alias("notified"))


@query("c10_same_organization_savers", "SELECT DISTINCT i.id AS item_id, s.user_id FROM content_items i JOIN content_items j ON j.organization_id = i.organization_id AND j.type = 'job' JOIN saved_items s ON s.content_item_id = j.id WHERE i.status = 'published' AND i.created_at >= TIMESTAMP '2024-01-30 00:00:00'")
def _(v: Views) -> DataFrame:
    items = v.content_items
    # a user counts once per organization, before organizations fan out to items
    savers = v.saved_items.join(items.where("type = 'job' and organization_id is not null").selectExpr("id as content_item_id", "organization_id"), "content_item_id").select("organization_id", "user_id").distinct()
    # written, so that their size is known: few enough to be broadcast, they leave no organization's savers to be sorted and buffered
    new = written(items.where("status = 'published' and created_at >= timestamp'2024-01-30 00:00:00' and organization_id is not null").selectExpr("id as item_id", "organization_id"), "new-of-organizations")
    return new.join(savers, "organization_id").select("item_id", "user_id")


#: One redirect a request: path as it is or without its last slash, never to either form of the request.
RESOLVED = """asked AS (SELECT *, CASE WHEN length(path) > 1 AND ends_with(path, '/') THEN left(path, length(path) - 1) ELSE path END AS plain FROM requests WHERE NOT (starts_with(path, '/admin') OR starts_with(path, '/api') OR starts_with(path, '/_astro') OR path = '/maintenance')),
resolved AS (SELECT request_id, ts, from_path, to_path FROM asked r JOIN (SELECT DISTINCT from_path, to_path FROM redirects WHERE active) d ON (d.from_path = r.path OR d.from_path = r.plain) AND d.to_path <> r.path AND d.to_path <> r.plain AND d.to_path <> ''
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN from_path = path THEN 0 ELSE 1 END, to_path) = 1)"""


@query("c12_redirect_resolution", f"WITH {RESOLVED} SELECT request_id, to_path FROM resolved")
def _(v: Views) -> DataFrame:
    from gazette.streaming.streams import resolve_redirects

    return resolve_redirects(v.requests, v.redirects).select("request_id", "to_path")


@query("e1_pagination", PUBLIC + f", hits AS (SELECT * FROM public) SELECT id, {TOTALS.format(page=3, limit=50)}, 3 < CAST(ceil((SELECT count(*) FROM hits) / 50.0) AS BIGINT) AS has_next, true AS has_prev FROM hits ORDER BY {LATEST} LIMIT 50 OFFSET 100")
def _(v: Views) -> DataFrame:
    return listing.page_of(public(v), listing.order(), page=3, limit=500).select("id", "total", "page", "total_pages", "has_next", "has_prev")


@query("e1_deep_page", PUBLIC + f", hits AS (SELECT * FROM public) SELECT id, {TOTALS.format(page=30, limit=12)}, 30 < CAST(ceil((SELECT count(*) FROM hits) / 12.0) AS BIGINT) AS has_next, true AS has_prev FROM hits ORDER BY {LATEST} LIMIT 12 OFFSET 348")
def _(v: Views) -> DataFrame:
    """A page far in, out of the one range that holds it."""
    return Pages.of(public(v).select("id", "published_at", "created_at"), listing.order()).page(30, 12).select("id", "total", "page", "total_pages", "has_next", "has_prev")


@query("e2_sort_by_vacancies", PUBLIC + "SELECT id, vacancy FROM public WHERE type = 'job' ORDER BY CASE WHEN vacancy IS NULL THEN NULL ELSE coalesce(try_cast(nullif(regexp_extract(vacancy, '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT), 0) END DESC NULLS LAST, id LIMIT 25")
def _(v: Views) -> DataFrame:
    return listing.filtered(public(v), type="job").orderBy(*listing.order("vacancies")).limit(25).select("id", "vacancy")


@query("e3_newest_per_type", PUBLIC + f"SELECT id, type, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY {LATEST}) AS rank FROM public) WHERE rank <= CASE type WHEN 'job' THEN 8 WHEN 'result' THEN 6 WHEN 'admit_card' THEN 6 WHEN 'answer_key' THEN 6 ELSE 0 END")
def _(v: Views) -> DataFrame:
    return listing.newest_per_type(public(v)).select("id", "type", "rank")


@query("e4_closing_soon", PUBLIC + f"SELECT id, application_last_date FROM public WHERE type = 'job' AND application_last_date >= date_trunc('day', TIMESTAMP '{AS_OF}') ORDER BY application_last_date, id LIMIT 6")
def _(v: Views) -> DataFrame:
    return listing.closing_soon(public(v), AS_OF).select("id", "application_last_date")


@query("e5_recently_updated", PUBLIC + "SELECT id, updated_at FROM public WHERE updated_at > created_at ORDER BY updated_at DESC, id LIMIT 6")
def _(v: Views) -> DataFrame:
    return listing.recently_updated(public(v)).select("id", "updated_at")


@query("e6_related", """WITH p AS (SELECT * FROM content_items WHERE status = 'published'),
pairs AS (SELECT a.id, b.id AS related_id, b.published_at, b.created_at, CASE WHEN a.organization_id = b.organization_id THEN 1 WHEN a.category_id = b.category_id THEN 2 ELSE 3 END AS tier
  FROM p a JOIN p b ON a.id <> b.id AND (a.organization_id = b.organization_id OR a.category_id = b.category_id OR a.type = b.type)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, published_at DESC NULLS LAST, created_at DESC NULLS LAST, related_id) AS rank FROM pairs)
SELECT id, related_id, tier, rank::INT AS rank FROM ranked WHERE rank <= 6""")
def _(v: Views) -> DataFrame:
    return listing.related(v.content_items.where("status = 'published'"))


@query("e6_related_strict", """WITH p AS (SELECT * FROM content_items WHERE status = 'published'),
pairs AS (SELECT a.id, b.id AS related_id, t, row_number() OVER (PARTITION BY a.id, t ORDER BY b.published_at DESC NULLS LAST, b.created_at DESC NULLS LAST, b.id) AS r
  FROM p a JOIN p b ON a.id <> b.id JOIN (VALUES (1), (2), (3)) tiers(t) ON (t = 1 AND a.organization_id = b.organization_id) OR (t = 2 AND a.category_id = b.category_id) OR (t = 3 AND a.type = b.type)),
one AS (SELECT id, related_id, r FROM pairs WHERE t = 1 AND r <= 6), n1 AS (SELECT p.id, count(one.id) AS n FROM p LEFT JOIN one USING (id) GROUP BY p.id),
two AS (SELECT x.id, x.related_id, x.r FROM pairs x JOIN n1 USING (id) WHERE t = 2 AND x.r <= 6 - n1.n AND NOT EXISTS (SELECT 1 FROM one WHERE one.id = x.id AND one.related_id = x.related_id)),
n2 AS (SELECT n1.id, any_value(n1.n) + count(two.id) AS n FROM n1 LEFT JOIN two USING (id) GROUP BY n1.id),
three AS (SELECT x.id, x.related_id, x.r FROM pairs x JOIN n2 USING (id) WHERE t = 3 AND x.r <= 6 - n2.n AND NOT EXISTS (SELECT 1 FROM one WHERE one.id = x.id AND one.related_id = x.related_id) AND NOT EXISTS (SELECT 1 FROM two WHERE two.id = x.id AND two.related_id = x.related_id)),
every AS (SELECT *, 1 AS tier FROM one UNION ALL SELECT *, 2 FROM two UNION ALL SELECT *, 3 FROM three)
SELECT id, related_id, tier, row_number() OVER (PARTITION BY id ORDER BY tier, r)::INT AS rank FROM every""")
def _(v: Views) -> DataFrame:
    return listing.related(v.content_items.where("status = 'published'"), strict=True)


@query("x1_top_searches", "SELECT lower(trim(query)) AS query, count(*) AS hits FROM search_events GROUP BY 1 ORDER BY hits DESC, query LIMIT 10")
def _(v: Views) -> DataFrame:
    return v.search_events.groupBy(F.lower(F.trim("query")).alias("query")).agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "query").limit(10)


_PAGES = "pages_seen AS (SELECT concat('pg_', k) AS id, concat('https://', source, '.example.org/n/', k - k % 3) AS url, TIMESTAMP '2024-01-01 00:00:00' + MINUTES(CAST(u DIV 32 % 43200 AS INT)) AS last_changed_at FROM keyed_documents)"


@query("c4_pending_pages", f"WITH {_PAGES}, last AS (SELECT source_url, arg_max(status, (updated_at, id)) AS status, max(updated_at) AS updated_at FROM content_items WHERE status <> 'archived' GROUP BY 1) SELECT p.id, p.url, p.last_changed_at FROM pages_seen p LEFT JOIN last i ON i.source_url = p.url WHERE i.source_url IS NULL OR i.status IN ('draft', 'review') OR p.last_changed_at > i.updated_at ORDER BY p.last_changed_at DESC, p.id LIMIT 10")
def _(v: Views) -> DataFrame:
    pages = v.keyed_documents.selectExpr("concat('pg_', k) as id", "concat('https://', source, '.example.org/n/', k - k % 3) as url", "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(u div 32 % 43200 as int)) as last_changed_at")
    return listing.pending_pages(pages, v.content_items.where("status <> 'archived'"))


@query("x5_discovered_union", "SELECT page_id AS id, 'html' AS format, length(html)::VARCHAR AS n, NULL::VARCHAR AS query FROM {pages} UNION ALL SELECT event_id, 'search', NULL, query FROM search_events")
def _(v: Views) -> DataFrame:
    pages = v.raw("pages").select(F.col("page_id").alias("id"), F.lit("html").alias("format"), F.length("html").cast("string").alias("n"))
    return listing.discovered(pages, v.search_events.select(F.col("event_id").alias("id"), F.lit("search").alias("format"), "query"))
