"""Tables of the notice domain, derived from the supplied tables by one definition in SQL.

The text is common to Spark and DuckDB but for whole-number division and interval arithmetic, which are written
``a DIV b``, ``MINUTES(n)``, ``HOURS(n)`` and ``DAYS(n)`` and rendered for either. Raw tables stand in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from gazette.sources import tables

#: Every operator takes its time as a parameter; the queries use this one.
AS_OF = "2024-01-31 00:00:00"
RAW = ("nation", "region", "customer", "orders", "lineitem", "events", "documents", "labels", "pages")
HASH = "(({k} * 2654435761) % 4294967296)"


def _hash(key: str) -> str:
    return HASH.replace("{k}", f"CAST({key} AS BIGINT)")


VIEWS: dict[str, str] = {
    "keyed_documents": f"SELECT d.doc_id AS k, {_hash('d.doc_id')} AS u, d.source, l.quality FROM {{documents}} d LEFT JOIN {{labels}} l ON l.doc_id = d.doc_id",
    "content_items": """
SELECT k, u, concat('ci_', k) AS id, type, title, lower(replace(concat(title, '-', k), ' ', '-')) AS slug, exam_token,
  CASE WHEN u % 11 <> 0 THEN concat('org_', k % 25) END AS organization_id, CASE WHEN u % 7 <> 0 THEN concat('cat_', k % 5) END AS category_id,
  status, concat('https://', source, '.example.org/n/', k) AS source_url, source AS source_id,
  CASE WHEN status = 'published' THEN created_at END AS published_at, created_at, created_at + HOURS(CAST(u % 3 AS INT)) AS updated_at,
  u % 29 = 0 AS sponsored, CASE WHEN u % 13 = 0 THEN 'verification_required' ELSE 'verified' END AS verification_status,
  CASE WHEN quality = 1 THEN 95 WHEN quality = 0 THEN 60 ELSE 80 END AS quality_score, u % 19 < 9 AS auto_publish_eligible,
  CASE WHEN u % 17 = 0 THEN 'conflict' ELSE 'unique' END AS duplicate_status, yr,
  CASE WHEN u % 10 < 2 THEN concat(lpad(concat(u DIV 16 % 40), 2, '0'), '/', yr) END AS advertisement_number
FROM (
  SELECT k, u, source, quality, yr, exam_token, concat(org_token, ' ', exam_token, ' Recruitment ', yr) AS title,
    CASE WHEN u DIV 4096 % 12 < 4 THEN 'job' WHEN u DIV 4096 % 12 < 6 THEN 'result' WHEN u DIV 4096 % 12 = 6 THEN 'admit_card' WHEN u DIV 4096 % 12 = 7 THEN 'answer_key'
      WHEN u DIV 4096 % 12 = 8 THEN 'exam' WHEN u DIV 4096 % 12 = 9 THEN 'scholarship' WHEN u DIV 4096 % 12 = 10 THEN 'scheme' ELSE 'update' END AS type,
    CASE WHEN u DIV 131072 % 6 < 3 THEN 'published' WHEN u DIV 131072 % 6 = 3 THEN 'draft' WHEN u DIV 131072 % 6 = 4 THEN 'review' ELSE 'archived' END AS status,
    TIMESTAMP '2024-01-01 00:00:00' + MINUTES(CAST(u DIV 64 % 43200 AS INT)) AS created_at
  FROM (
    SELECT k, u, source, quality, 2024 + u DIV 512 % 3 AS yr,
      CASE u DIV 1048576 % 6 WHEN 0 THEN 'SSC' WHEN 1 THEN 'UPSC' WHEN 2 THEN 'RRB' WHEN 3 THEN 'IBPS' WHEN 4 THEN 'NTA' ELSE 'State University' END AS org_token,
      CASE u DIV 8388608 % 6 WHEN 0 THEN 'CGL' WHEN 1 THEN 'NTPC' WHEN 2 THEN 'PO' WHEN 3 THEN 'CDS' WHEN 4 THEN 'Clerk' ELSE 'Officer' END AS exam_token
    FROM keyed_documents) a) b""",
    "jobs": """
SELECT content_item_id, post_name, qualification, application_last_date, application_last_date - DAYS(30) AS application_start,
  CASE WHEN k % 7 = 0 AND n >= 1000 THEN concat(n DIV 1000, ',', lpad(concat(n % 1000), 3, '0')) WHEN k % 13 = 0 THEN NULL ELSE concat(n) END AS vacancy,
  concat('https://apply.example.gov.in/', k) AS apply_url, CASE WHEN k % 3 = 0 THEN concat('https://files.example.gov.in/n', k % 50, '.pdf') END AS official_notification_url
FROM (SELECT k, id AS content_item_id, exam_token AS post_name, u DIV 32 % 500 * 37 AS n,
    CASE u % 4 WHEN 0 THEN '10th' WHEN 1 THEN '12th' WHEN 2 THEN 'Graduate' ELSE 'Post Graduate' END AS qualification,
    CASE WHEN u % 17 <> 0 THEN TIMESTAMP '2024-01-26 00:00:00' + DAYS(CAST(u DIV 256 % 40 AS INT)) END AS application_last_date
  FROM content_items WHERE type = 'job') a""",
    "organizations": "SELECT concat('org_', n_nationkey) AS id, n_name AS name, lower(replace(n_name, ' ', '-')) AS slug, CASE WHEN n_nationkey % 12 = 11 THEN 'inactive' ELSE 'active' END AS status FROM {nation}",
    "categories": "SELECT concat('cat_', r_regionkey) AS id, r_name AS name, lower(replace(r_name, ' ', '-')) AS slug, r_regionkey AS sort_order FROM {region}",
    "sources": """
SELECT source AS id, upper(source) AS name, concat('https://', source, CASE ord % 4 WHEN 0 THEN '.gov.in' WHEN 1 THEN '.employmentnews.example.com' WHEN 2 THEN '.jobresult.example.com' ELSE '.example.org' END) AS base_url,
  1 + ord % 5 AS trust_level, 1 + ord % 5 AS priority, CASE ord % 11 WHEN 0 THEN '10m' WHEN 1 THEN '15m' WHEN 2 THEN '30m' WHEN 3 THEN '1h' WHEN 4 THEN 'hourly' WHEN 5 THEN '3h' WHEN 6 THEN '6h' WHEN 7 THEN '12h' WHEN 8 THEN 'daily' WHEN 9 THEN 'weekly' ELSE 'manual' END AS crawl_frequency,
  CASE WHEN ord % 8 <> 7 THEN TIMESTAMP '2024-01-31 00:00:00' - HOURS(CAST(ord % 30 AS INT)) END AS last_checked_at, CASE WHEN ord % 6 = 5 THEN 'paused' ELSE 'active' END AS status, ord % 5 AS consecutive_failures
FROM (SELECT source, CAST(row_number() OVER (ORDER BY source) - 1 AS BIGINT) AS ord FROM (SELECT DISTINCT source FROM {documents}) s) t""",
    "users": f"""
SELECT k, concat('u_', k) AS id, concat('user', k, '@example.org') AS email, name, CASE WHEN k % 20 = 0 THEN 'suspended' ELSE 'active' END AS status, k % 9 <> 0 AS email_verified,
  TIMESTAMP '2024-01-31 12:00:00' - DAYS(CAST(k % 45 AS INT)) AS created_at, u % 8 <> 0 AS mail_on, u DIV 8 % 2 = 0 AS on_job, u DIV 16 % 2 = 0 AS on_result, u DIV 32 % 2 = 0 AS on_admit_card, u DIV 64 % 2 = 0 AS on_answer_key, u DIV 128 % 2 = 0 AS on_other, u DIV 256 % 2 = 0 AS on_reminder, u DIV 512 % 3 AS digest
FROM (SELECT c_custkey AS k, c_name AS name, {_hash('c_custkey')} AS u FROM {{customer}}) c""",
    "saved_items": "SELECT concat('u_', o_custkey) AS user_id, concat('ci_', o_orderkey % n) AS content_item_id, min(o_orderdate) AS created_at FROM {orders} CROSS JOIN (SELECT count(*) AS n FROM {documents}) d GROUP BY 1, 2",
    "followed_organizations": "SELECT concat('u_', c_custkey) AS user_id, concat('org_', c_nationkey) AS organization_id FROM {customer}",
    "followed_categories": "SELECT concat('u_', c_custkey) AS user_id, concat('cat_', n_regionkey) AS category_id FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey",
    "notifications": """
SELECT concat('nt_', event_id) AS id, concat('u_', user_id) AS user_id, CASE WHEN event_type = 'view' THEN 'new_item' ELSE 'deadline' END AS type, concat('ci_', event_id % n) AS content_item_id,
  CASE WHEN event_id % 5 < 2 THEN 'pending' WHEN event_id % 5 = 3 THEN 'failed' ELSE 'sent' END AS status, event_id % 4 AS retry_count, ts AS created_at, CASE WHEN event_id % 3 = 0 THEN ts + HOURS(1) END AS read_at
FROM {events} CROSS JOIN (SELECT count(*) AS n FROM {documents}) d WHERE event_type IN ('view', 'click')""",
    "crawl_logs": """
SELECT concat('run_', user_id, '_', d) AS execution_id, concat('src', user_id % 20) AS source_id, min(ts) AS started_at, count(*) AS discovered, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS new_items, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS updated_items,
  sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS errors, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS documents_found, sum(event_id % 6000) AS response_ms
FROM (SELECT *, date_trunc('day', ts) AS day0, extract(day FROM ts) AS d FROM {events}) e GROUP BY user_id, day0, d""",
    "ai_generations": "SELECT event_id AS id, event_type AS operation, CAST(floor(value) AS BIGINT) AS input_tokens, event_id % 700 AS output_tokens, event_id % 3000 AS duration_ms, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, ts AS created_at FROM {events}",
    "error_logs": "SELECT event_id AS id, ts AS created_at, concat('src', user_id % 20) AS source_id, props AS metadata, event_id % 3 = 0 AS resolved FROM {events} WHERE event_type = 'error'",
    "search_events": "SELECT event_id, concat(CASE WHEN event_id % 2 = 0 THEN ' Q' ELSE 'q' END, user_id % 40) AS query, CAST(floor(value) AS BIGINT) % 5 AS results_count, ts FROM {events} WHERE event_type IN ('click', 'view')",
    "webhook_events": "SELECT concat('we_', event_id DIV 2) AS event_id, event_id AS seq, concat('sub_', user_id) AS subscription_id, CASE WHEN event_id % 7 = 0 THEN 'cancelled' WHEN event_id % 2 = 0 THEN 'created' ELSE 'paid' END AS kind, ts FROM {events} WHERE event_type = 'purchase'",
    "delivery_attempts": "SELECT concat('nt_', user_id) AS notification_id, event_id AS seq, CASE WHEN event_type = 'signup' THEN 'retry' WHEN event_type = 'view' AND event_id % 4 = 0 THEN 'success' ELSE 'fail' END AS outcome, ts FROM {events} WHERE event_type IN ('error', 'view', 'signup')",
    "revenue_records": "SELECT CASE l_returnflag WHEN 'A' THEN 'advertising' WHEN 'N' THEN 'subscription' ELSE 'sponsored' END AS revenue_type, CAST(l_extendedprice AS DECIMAL(18, 2)) AS amount, date_trunc('month', l_shipdate) AS period FROM {lineitem}",
    "page_paths": "SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+', ''), '[?#].*$', '') AS path FROM {pages}",
    "redirects": "SELECT p.path AS from_path, q.path AS to_path, p.page_id % 3 <> 0 AS active FROM page_paths p JOIN page_paths q ON q.page_id = p.page_id + 1 WHERE p.page_id % 5 = 0",
    "requests": "SELECT page_id AS request_id, CASE WHEN page_id % 2 = 1 THEN concat(path, '/') ELSE path END AS path, TIMESTAMP '2024-01-30 00:00:00' + MINUTES(CAST(page_id % 1440 AS INT)) AS ts FROM page_paths",
    "decisions": "SELECT concat('ci_', event_id % n) AS item_id, CASE event_type WHEN 'view' THEN 'approve' WHEN 'click' THEN 'draft' ELSE 'reject' END AS action, ts, event_id AS seq FROM {events} CROSS JOIN (SELECT count(*) AS n FROM {documents}) d",
    "subscriptions": """
SELECT concat('sb_', k, '_', n) AS id, concat('u_', k) AS user_id, CASE k % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'plus' ELSE 'pro' END AS plan_id, CASE (k + n) % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'trialing' WHEN 2 THEN 'cancelled' ELSE 'past_due' END AS status,
  TIMESTAMP '2024-01-11 00:00:00' + DAYS(CAST(k % 60 AS INT)) AS period_end, TIMESTAMP '2024-01-30 00:00:00' - DAYS(CAST((k + 7 * n) % 90 AS INT)) AS created_at
FROM (SELECT c_custkey AS k FROM {customer}) c CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 AS n) two WHERE k % 2 = 0 AND (n = 0 OR k % 5 = 0)""",
    "plans": """SELECT 'free' AS id, CAST(0 AS DECIMAL(18, 2)) AS price, '["alerts"]' AS features UNION ALL SELECT 'plus' AS id, CAST(99 AS DECIMAL(18, 2)) AS price, '["alerts","digest"]' AS features UNION ALL SELECT 'pro' AS id, CAST(299 AS DECIMAL(18, 2)) AS price, '["alerts","digest","api"]' AS features""",
    "extractions": """
SELECT i.id, i.k, i.title, coalesce(j.vacancy, '') AS vacancy, coalesce(i.advertisement_number, '') AS advertisement_number, coalesce(d.day, '') AS application_last_date, j.post_name, s.trust_level, i.k % 5 AS evidence_count,
  CASE i.k % 9 WHEN 0 THEN 'https://bit.ly/x' WHEN 1 THEN 'not a url' WHEN 2 THEN 'ftp://files.example.gov.in/a' WHEN 3 THEN 'https://www.example.com/apply' ELSE j.apply_url END AS official_apply_url, coalesce(j.official_notification_url, '') AS official_notification_url, s.base_url,
  concat('Total posts: ', CASE WHEN i.k % 6 = 0 THEN '12354' ELSE coalesce(j.vacancy, 'many') END, '. Advt. No. ', CASE WHEN i.k % 4 = 0 THEN '--' ELSE coalesce(i.advertisement_number, '') END,
    '. Apply by ', CASE WHEN i.k % 3 = 0 THEN concat(substring(d.day, 9, 2), ' ', CASE substring(d.day, 6, 2) WHEN '01' THEN 'January' WHEN '02' THEN 'February' ELSE 'March' END, ' ', substring(d.day, 1, 4)) WHEN i.k % 3 = 1 THEN coalesce(d.day, '') ELSE 'soon' END) AS source_text
FROM content_items i JOIN jobs j ON j.content_item_id = i.id JOIN sources s ON s.id = i.source_id
JOIN (SELECT content_item_id, CASE WHEN application_last_date IS NOT NULL THEN substring(concat(application_last_date), 1, 10) ELSE '' END AS day FROM jobs) d ON d.content_item_id = i.id""",
}
#: Landing pages with their filter, threshold and index flag.
LANDING_PAGES = (
    ("prog_qual_10th", "10th-pass", "qualification", "10th"),
    ("prog_qual_12th", "12th-pass", "qualification", "12th"),
    ("prog_qual_grad", "graduate", "qualification", "Graduate"),
    ("prog_qual_pg", "post-graduate", "qualification", "Post Graduate"),
    ("prog_cat_rrb", "railway", "search", "Railway"),
    ("prog_cat_bank", "banking", "search", "Banking"),
    ("prog_cat_def", "defence", "search", "Defence"),
    ("prog_cat_teach", "teaching", "search", "Teaching"),
    ("prog_cat_police", "police", "search", "Police"),
    ("prog_cat_upsc", "upsc", "search", "UPSC"),
    ("prog_cat_ssc", "ssc", "search", "SSC"),
)
VIEWS["programmatic_pages"] = " UNION ALL ".join(f"SELECT '{i}' AS id, '{slug}' AS slug, '{kind}' AS kind, '{term}' AS term, 1 AS min_content_threshold, true AS is_indexable" for i, slug, kind, term in LANDING_PAGES)


def _needed(text: str) -> list[str]:
    """Views that the text names, in the order of their definition, with those that they need."""
    found: set[str] = set()
    due = [text]
    while due:
        words = set(re.findall(r"[a-z_]+", due.pop()))
        new = {v for v in VIEWS if v in words} - found
        found |= new
        due += [VIEWS[v] for v in new]
    return [v for v in VIEWS if v in found]


def _with(body: str) -> str:
    """body with the views it names before it. A body that begins with WITH, or WITH RECURSIVE, goes on from there."""
    names = _needed(body)
    if not names:
        return body
    views, rest, start = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names), body.lstrip(), "WITH "
    if (m := re.match(r"WITH\s+(RECURSIVE\s+)?", rest, re.IGNORECASE)) is not None:
        start, rest = ("WITH RECURSIVE " if m[1] else "WITH "), f", {rest[m.end():]}"
        return f"{start}{views}{rest}"
    return f"{start}{views} {rest}"


def _calls(text: str, name: str, render) -> str:
    """Replace name(argument) by render(argument); arguments may hold parentheses."""
    while (m := re.search(rf"\b{name}\(", text)) is not None:
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            i += 1
        text = text[: m.start()] + render(text[m.end() : i - 1]) + text[i:]
    return text


def duckdb_sql(body: str) -> str:
    """body for DuckDB, with the views it names before it."""
    text = _with(body)
    for name, f in (("MINUTES", "to_minutes"), ("HOURS", "to_hours"), ("DAYS", "to_days")):
        text = _calls(text, name, lambda x, f=f: f"{f}({x})")
    return re.sub(r"\{(\w+)\}", r"\1", text.replace(" DIV ", " // "))


class Views:
    """The derived tables of one folder, as attributes; raw tables too."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return tables.load(self.spark, self.sf_dir, name).rows

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            if name.startswith("_"):
                raise AttributeError(name)
            return self.raw(name)
        return self.sql(f"SELECT * FROM {name}")

    def sql(self, body: str) -> DataFrame:
        """body over the derived tables that it names."""
        text = _with(body).replace(" DIV ", " div ")
        for call, before in (("MINUTES", "0, 0, "), ("HOURS", "0, "), ("DAYS", "")):
            text = _calls(text, call, lambda x, before=before: f"make_dt_interval({before}{x})")
        used = {t: self.raw(t) for t in RAW if f"{{{t}}}" in text}
        return self.spark.sql(text, **used)
