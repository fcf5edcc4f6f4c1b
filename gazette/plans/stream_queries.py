"""Queries over change detection, event folds and daily metrics, run as batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.functions import exprs, templates
from gazette.operators.listing import STATES
from gazette.plans import alert_queries
from gazette.plans.listing_queries import RESOLVED, public
from gazette.plans.registry import query
from gazette.plans.views import AS_OF, Views
from gazette.session import scratch
from gazette.sources import feeds
from gazette.streaming import jobs, streams

_SEEN = "seen AS (SELECT page_id, concat('src', page_id % 20) AS source_id, regexp_replace(url, '[?#].*$', '') AS normalized_url, sha256(html) AS fp FROM {pages}), snap AS (SELECT source_id, normalized_url, min(CASE WHEN page_id % 10 = 8 THEN sha256(concat(fp, 'x')) ELSE fp END) AS fp FROM seen WHERE page_id % 10 <> 9 GROUP BY 1, 2)"


@query("t1_page_changes", f"WITH {_SEEN} SELECT page_id, CASE WHEN s.fp IS NULL THEN 'NEW' WHEN s.fp <> o.fp THEN 'UPDATED' ELSE 'UNCHANGED' END AS page_status, CASE WHEN s.fp IS NULL THEN EXISTS (SELECT 1 FROM snap k WHERE k.source_id = o.source_id AND k.fp = o.fp) ELSE s.fp = o.fp END AS repeats_content FROM seen o LEFT JOIN snap s ON s.source_id = o.source_id AND s.normalized_url = o.normalized_url")
def _(v: Views) -> DataFrame:
    seen = v.raw("pages").select("page_id", F.expr("concat('src', page_id % 20)").alias("source_id"), F.regexp_replace("url", "[?#].*$", "").alias("normalized_url"), F.lit(None).cast("string").alias("canonical_url"), F.sha2("html", 256).alias("fingerprint"))
    old = seen.where("page_id % 10 <> 9").groupBy("source_id", "normalized_url").agg(F.min(F.expr("case when page_id % 10 = 8 then sha2(concat(fingerprint, 'x'), 256) else fingerprint end")).alias("fingerprint"))
    return streams.page_changes(old.withColumn("canonical_url", F.lit(None).cast("string")), seen).select("page_id", "page_status", "repeats_content")


@query("t2_search_hits", "SELECT lower(trim(query)) AS query, count(*) AS hits, max(ts) AS last_seen FROM search_events GROUP BY 1")
def _(v: Views) -> DataFrame:
    return streams.search_hits(v.search_events).select("query", "hits", "last_seen")


@query("t6_redirect_hits", f"WITH {RESOLVED} SELECT from_path, to_path, count(*) AS hits, max(ts) AS last_access FROM resolved GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return streams.redirect_hits(v.requests, v.redirects)


@query("t7_daily_metrics", "SELECT date_trunc('day', created_at)::TIMESTAMP AS day, count(*) AS n, sum(input_tokens)::BIGINT AS tokens, count(*) FILTER (status = 'failed') AS failed FROM ai_generations GROUP BY 1")
def _(v: Views) -> DataFrame:
    return streams.daily(v.ai_generations, "created_at", tokens=F.sum("input_tokens"), failed=F.count_if(F.col("status") == "failed"))


_LOGS = "logs AS (SELECT source_id, execution_id AS run_id, started_at AS ts, response_ms, errors = 0 AS ok FROM crawl_logs)"


def logs(v: Views) -> DataFrame:
    return v.crawl_logs.selectExpr("source_id", "execution_id as run_id", "started_at as ts", "response_ms", "errors = 0 as ok")


@query("e11_failure_runs", f"WITH {_LOGS}, i AS (SELECT *, sum(ok::INT) OVER (PARTITION BY source_id ORDER BY ts, run_id ROWS UNBOUNDED PRECEDING) AS island FROM logs) SELECT source_id, run_id, (sum((NOT ok)::INT) OVER (PARTITION BY source_id, island ORDER BY ts, run_id ROWS UNBOUNDED PRECEDING))::BIGINT AS failures_in_a_row FROM i")
def _(v: Views) -> DataFrame:
    return streams.failure_runs(logs(v)).select("source_id", "run_id", "failures_in_a_row")


@query("t8_source_health", f"""WITH {_LOGS}, i AS (SELECT *, sum(ok::INT) OVER (PARTITION BY source_id ORDER BY ts, run_id ROWS UNBOUNDED PRECEDING) AS island FROM logs), f AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY source_id, island ORDER BY ts, run_id ROWS UNBOUNDED PRECEDING) AS failures FROM i),
g AS (SELECT source_id, arg_max(failures, (ts, run_id))::BIGINT AS failures, list_reduce(list(response_ms::DOUBLE ORDER BY ts, run_id), lambda a, b: CASE WHEN a = 0 THEN b ELSE floor((a + b) / 2 + 0.5) END) AS mean_ms, arg_max(response_ms, (ts, run_id))::BIGINT AS last_ms, max(ts) FILTER (ok) AS last_success FROM f GROUP BY 1)
SELECT *, CASE WHEN failures >= 3 THEN 'failed' WHEN failures > 0 OR last_ms > 5000 THEN 'warning' ELSE 'healthy' END AS health FROM g""")
def _(v: Views) -> DataFrame:
    return streams.source_health(logs(v))


@query("e12_response_average", f"WITH {_LOGS} SELECT source_id, list_reduce(list(response_ms::DOUBLE ORDER BY ts, run_id), lambda a, b: CASE WHEN a = 0 THEN b ELSE floor((a + b) / 2 + 0.5) END) AS mean_ms FROM logs GROUP BY 1")
def _(v: Views) -> DataFrame:
    return streams.response_means(logs(v))


@query("t9_toggles", "SELECT concat('u_', user_id) AS user_id, concat('ci_', event_id % 9) AS target_id, max(ts) AS since FROM {events} GROUP BY 1, 2 HAVING count(*) % 2 = 1")
def _(v: Views) -> DataFrame:
    return streams.toggles(v.raw("events").selectExpr("concat('u_', user_id) as user_id", "concat('ci_', event_id % 9) as target_id", "ts"))


@query("t10_read_state", "SELECT n.id, coalesce(n.k <= 5, false) OR coalesce(a.ts >= n.created_at, false) AS is_read FROM (SELECT *, CAST(substring(id, 4) AS BIGINT) % 40 AS k FROM notifications) n LEFT JOIN (SELECT concat('u_', user_id) AS user_id, max(ts) AS ts FROM {events} WHERE event_type = 'purchase' AND event_id % 5 = 0 GROUP BY 1) a ON a.user_id = n.user_id")
def _(v: Views) -> DataFrame:
    one = v.notifications.where("cast(substring(id, 4) as bigint) % 40 <= 5").selectExpr("id as notification_id", "created_at + interval 1 hour as ts")
    every = v.raw("events").where("event_type = 'purchase' and event_id % 5 = 0").selectExpr("concat('u_', user_id) as user_id", "ts")
    return streams.read_state(v.notifications, one, every).select("id", "is_read")


@query("t4_lifecycle", f"""WITH e AS (SELECT * FROM webhook_events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY seq) = 1),
s AS (SELECT subscription_id, arg_max(CASE WHEN kind = 'cancelled' THEN 'cancelled' ELSE 'active' END, (ts, seq)) AS status, max(ts) FILTER (kind <> 'cancelled') + INTERVAL 10 DAY AS period_end, max(ts) AS last FROM e GROUP BY 1)
SELECT subscription_id, CASE WHEN status = 'active' AND period_end <= TIMESTAMP '{AS_OF}' THEN 'expired' ELSE status END AS status, period_end FROM s WHERE coalesce(period_end, last) + INTERVAL 7 DAY > TIMESTAMP '{AS_OF}'""")
def _(v: Views) -> DataFrame:
    """Periods of ten days."""
    return streams.subscription_lifecycle(streams.first_deliveries(v.webhook_events), AS_OF, days=10)


@query("a9_bucketed_upsert", "SELECT lower(trim(query)) AS query, count(*) AS hits, max(ts) AS last_seen FROM search_events GROUP BY 1")
def _(v: Views) -> DataFrame:
    """The searches of each week upserted into a keyed table, week by week; the last twice, as after a failure."""
    table = jobs.KeyedTable(v.spark, f"{scratch(v.spark)}/searches-{uuid.uuid4().hex}", *jobs.SEARCHES, buckets=16)
    rules = jobs._summed("hits", last_results=F.coalesce("new_last_results", "old_last_results"), last_seen=F.greatest("old_last_seen", "new_last_seen"))
    events = v.search_events
    weeks = [r[0] for r in events.select(F.date_trunc("week", "ts")).distinct().orderBy(F.col("date_trunc(week, ts)")).collect()]
    for n, week in enumerate([*weeks, *weeks[-1:]]):
        table.upsert(streams.search_hits(events.where(F.date_trunc("week", "ts") == F.lit(week))), min(n, len(weeks) - 1), rules)
    return table.read().select("query", "hits", "last_seen")


@query("t11_purge", f"SELECT id FROM subscriptions WHERE period_end >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY")
def _(v: Views) -> DataFrame:
    return streams.unexpired(v.subscriptions, AS_OF, "period_end").select("id")


@query("a8_capped", "SELECT page_id, source_id FROM (SELECT page_id, concat('src', page_id % 20) AS source_id, row_number() OVER (PARTITION BY page_id % 20 ORDER BY page_id) AS r FROM {pages}) WHERE r <= 5")
def _(v: Views) -> DataFrame:
    from gazette.operators.listing import capped

    return capped(v.raw("pages").selectExpr("page_id", "concat('src', page_id % 20) as source_id", "page_id as pos"), 5).select("page_id", "source_id")


_SITEMAP = """sections AS (SELECT * FROM (VALUES ('jobs', 'job'), ('results', 'result'), ('admit-card', 'admit_card'), ('answer-key', 'answer_key'), ('exams', 'exam')) AS t(section, type)),
listed AS (SELECT s.section, i.* FROM content_items i JOIN sections s ON s.type = i.type WHERE i.status = 'published'),
heads AS (SELECT section, first(updated_at::DATE ORDER BY published_at DESC NULLS LAST, id) AS lastmod FROM listed GROUP BY section),
entries AS (
  SELECT s.section AS kind, concat('/', s.section) AS path, h.lastmod::VARCHAR AS lastmod, 'daily' AS changefreq, 0.9::DOUBLE AS priority FROM sections s LEFT JOIN heads h ON h.section = s.section
  UNION ALL SELECT section, concat('/', section, '/', slug), coalesce(updated_at, published_at)::DATE::VARCHAR, 'weekly', 0.8 FROM listed
  UNION ALL SELECT 'organizations', '/organizations', NULL, 'weekly', 0.8
  UNION ALL SELECT 'organizations', concat('/organizations/', slug), (TIMESTAMP '2024-01-01' + DAYS(CAST(length(name) AS INT)))::DATE::VARCHAR, 'weekly', 0.7 FROM organizations o WHERE EXISTS (SELECT 1 FROM content_items i WHERE i.organization_id = o.id AND i.status = 'published')
  UNION ALL SELECT 'states', '/states', NULL, 'weekly', 0.8
  UNION ALL SELECT 'states', concat('/states/', replace(lower(state), ' ', '-')), NULL, 'weekly', 0.7 FROM (VALUES {states}) AS t(state)
  UNION ALL SELECT 'landing', concat('/jobs/', slug), NULL, 'daily', 0.85 FROM programmatic_pages WHERE is_indexable
  UNION ALL SELECT 'static', path, NULL, CASE WHEN path = '/' THEN 'daily' ELSE 'monthly' END, CASE WHEN path = '/' THEN 1.0 ELSE 0.5 END FROM (VALUES {paths}) AS t(path))""".replace("{states}", ", ".join(f"('{x}')" for x in STATES)).replace("{paths}", ", ".join(f"('{x}')" for x in feeds.STATIC_PATHS))


def site(v: Views) -> DataFrame:
    organizations = v.organizations.withColumn("updated_at", F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(length(name))"))
    return feeds.sitemap(v.content_items.where("status = 'published'"), organizations, v.programmatic_pages.withColumn("updated_at", F.lit(None).cast("timestamp")))


@query("a11_sitemap", f"WITH {_SITEMAP} SELECT * FROM entries")
def _(v: Views) -> DataFrame:
    return site(v).withColumn("lastmod", F.col("lastmod").cast("string"))


@query("a11_sitemap_files", f"WITH {_SITEMAP} SELECT concat(kind, '-', (row_number() OVER (PARTITION BY kind ORDER BY path, lastmod NULLS FIRST, priority) - 1) // 50 + 1) AS file, path FROM entries")
def _(v: Views) -> DataFrame:
    """Files of 50 URLs."""
    return feeds.sitemap_files(site(v), urls=50).select("file", "path")


_DOC = "SELECT i.*, o.name AS organization_name, CASE WHEN o.id IS NULL THEN NULL ELSE concat('https://', o.slug, '.example.org') END AS organization_website, j.qualification, j.vacancy AS salary, j.application_last_date, CASE WHEN i.k % 3 = 0 THEN '' ELSE concat('About ', i.title) END AS excerpt FROM content_items i LEFT JOIN organizations o ON o.id = i.organization_id LEFT JOIN jobs j ON j.content_item_id = i.id WHERE i.status = 'published'"


@query("a12_structured_data", f"""SELECT id, CASE WHEN type = 'job' THEN 'JobPosting' ELSE 'Article' END AS kind, title AS name, CASE WHEN excerpt = '' THEN title ELSE excerpt END AS description, strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') AS posted,
  CASE WHEN type = 'job' THEN concat('https://site.example.org/jobs/', slug) ELSE concat('https://site.example.org/', replace(type, '_', '-'), '/', slug) END AS url,
  CASE WHEN type = 'job' THEN coalesce(organization_name, 'Government of India') ELSE 'Gazette' END AS party, CASE WHEN type = 'job' THEN organization_website ELSE 'https://site.example.org' END AS party_url,
  CASE WHEN type = 'job' THEN 'IN' END AS country, CASE WHEN type = 'job' AND application_last_date IS NOT NULL THEN concat(strftime(application_last_date, '%Y-%m-%d'), 'T23:59:59+05:30') END AS valid_through, CASE WHEN type = 'job' THEN nullif(salary, '') END AS salary, CASE WHEN type = 'job' THEN qualification END AS education,
  CASE WHEN type = 'job' THEN 9 + (application_last_date IS NOT NULL)::INT + (nullif(salary, '') IS NOT NULL)::INT + (qualification IS NOT NULL)::INT ELSE 9 END AS n_keys FROM ({_DOC})""")
def _(v: Views) -> DataFrame:
    items = v.content_items.where("status = 'published'").join(v.organizations.selectExpr("id as organization_id", "name as organization_name", "concat('https://', slug, '.example.org') as organization_website"), "organization_id", "left")
    items = items.join(v.jobs.selectExpr("content_item_id as id", "qualification", "vacancy as salary", "application_last_date"), "id", "left").withColumns({"excerpt": F.expr("if(k % 3 = 0, '', concat('About ', title))"), "meta_description": F.lit(None).cast("string")})
    at = lambda *paths: F.coalesce(*[F.get_json_object("document", f"$.{p}") for p in paths])
    facts = {
        "kind": at("@type"), "name": at("title", "headline"), "description": at("description"), "posted": at("datePosted", "datePublished"), "url": at("url", "mainEntityOfPage['@id']"), "party": at("hiringOrganization.name", "publisher.name"), "party_url": at("hiringOrganization.sameAs", "publisher.url"),
        "country": at("jobLocation.address.addressCountry"), "valid_through": at("validThrough"), "salary": at("baseSalary.value.value"), "education": at("educationRequirements"), "n_keys": F.size(F.json_object_keys("document")),
    }
    return feeds.structured_data(items, "https://site.example.org/", "Gazette").select("id", *[c.alias(n) for n, c in facts.items()])


@query("a12_organization_data", "SELECT id, name, concat('https://', slug, '.example.org') AS url, CASE WHEN status = 'active' THEN concat('https://site.example.org/api/documents/', slug, '.png') END AS logo FROM organizations")
def _(v: Views) -> DataFrame:
    rows = v.organizations.selectExpr("id", "name", "concat('https://', slug, '.example.org') as website", "if(status = 'active', concat(slug, '.png'), '') as logo_key")
    return feeds.organization_data(rows, "https://site.example.org").select("id", *[F.get_json_object("document", f"$.{c}").alias(c) for c in ("name", "url", "logo")])


@query("a12_question_data", "SELECT id, CASE WHEN application_last_date <> '' THEN concat('The last date to submit the application is ', application_last_date, '.') ELSE concat('A total of ', vacancy, ' vacancies have been notified.') END AS first_answer, (vacancy <> '')::INT + (application_last_date <> '')::INT AS n FROM extractions WHERE vacancy <> '' OR application_last_date <> ''")
def _(v: Views) -> DataFrame:
    documents = feeds.question_data(v.extractions.select("id", templates.questions(["application_last_date", "vacancy"]).alias("faq")))
    return documents.select("id", F.get_json_object("document", "$.mainEntity[0].acceptedAnswer.text").alias("first_answer"), F.json_array_length(F.get_json_object("document", "$.mainEntity")).alias("n"))


@query("a7_pdf_archive", "SELECT checksum, min(url) AS path, 'ssc/2026/' || regexp_replace(regexp_extract(min(url), '([^/]+?)([.][^./]*)?$', 1), '[^A-Za-z0-9_-]+', '-', 'g') || '-' || substring(checksum, 1, 8) || '.pdf' AS storage_path FROM (SELECT url, sha256('%PDF-1.4 ' || html) AS checksum FROM {pages} WHERE url LIKE '%example.org%') GROUP BY checksum HAVING checksum NOT IN (SELECT sha256('%PDF-1.4 ' || html) FROM {pages} WHERE url LIKE 'https://%')")
def _(v: Views) -> DataFrame:
    """Bodies of one domain are documents; those that also stand under https are archived already."""
    files = v.raw("pages").selectExpr("url as path", "encode(concat(if(url like '%example.org%', '%PDF-1.4 ', ''), html), 'UTF-8') as content", "length(html) as length")
    archived = v.raw("pages").where("url like 'https://%'").selectExpr("sha2(concat('%PDF-1.4 ', html), 256) as checksum")
    return feeds.new_documents(files, archived, "ssc", 2026).select("checksum", "path", "storage_path")


@query("a10_log_sink", "SELECT created_at::DATE AS event_date, count(*) AS n, count(*) FILTER (resolved) AS resolved FROM error_logs GROUP BY 1")
def _(v: Views) -> DataFrame:
    path = f"{scratch(v.spark)}/error-logs-{uuid.uuid4().hex}"
    jobs.append_log(v.error_logs, path)
    return v.spark.read.parquet(path).groupBy("event_date").agg(F.count("*").alias("n"), F.count_if("resolved").alias("resolved"))


@query("t5_alert_stream", alert_queries.MATCH + "SELECT content_item_id, user_id, way, notification_type, alert_title FROM matched")
def _(v: Views) -> DataFrame:
    """The new items as a stream of files."""
    place = f"{scratch(v.spark)}/alerts-{uuid.uuid4().hex}"
    public(v).where(F.expr("created_at >= timestamp'2024-01-30 06:00:00'")).write.parquet(f"{place}/in")
    items = v.spark.readStream.schema(v.spark.read.parquet(f"{place}/in").schema).option("maxFilesPerTrigger", 1000).parquet(f"{place}/in")
    facts = {"all_items": v.content_items, "users": v.users, "organizations": v.followed_organizations, "categories": v.followed_categories, "saved": v.saved_items}
    jobs.alert_on_published(items, facts, f"{place}/queue", f"{place}/checkpoint").awaitTermination()
    return jobs.queue(v.spark, f"{place}/queue").read().select("content_item_id", "user_id", "way", "notification_type", "alert_title")


@query("x2_first_reason", alert_queries.MATCH + "SELECT way, count(*) AS n, count(DISTINCT user_id) AS users FROM matched GROUP BY way")
def _(v: Views) -> DataFrame:
    return alert_queries.alerts.reasons(alert_queries.new_items(v), *alert_queries.facts(v))


@query("x4_title_similarity", "SELECT a.id AS a_id, b.id AS b_id, len(list_intersect(string_split(lower(a.title), ' '), string_split(lower(b.title), ' ')))::DOUBLE / len(list_distinct(list_concat(string_split(lower(a.title), ' '), string_split(lower(b.title), ' ')))) AS similarity FROM content_items a JOIN content_items b ON b.k = a.k + 1")
def _(v: Views) -> DataFrame:
    a = v.content_items.select(F.col("id").alias("a_id"), "k", exprs.normalize_text(F.col("title")).alias("a_norm"))
    b = v.content_items.select(F.col("id").alias("b_id"), (F.col("k") - 1).alias("k"), exprs.normalize_text(F.col("title")).alias("b_norm"))
    rows = a.join(b, "k").withColumns({"a_tok": exprs.token_set(F.col("a_norm")), "b_tok": exprs.token_set(F.col("b_norm"))})
    return rows.select("a_id", "b_id", exprs.similarity(F.col("a_norm"), F.col("b_norm"), F.col("a_tok"), F.col("b_tok")).alias("similarity"))
