"""Queries over verification, quality, publishing, linking and URL rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.functions import exprs, templates, text
from gazette.operators import verify
from gazette.plans.listing_queries import PUBLIC, public
from gazette.plans.registry import query
from gazette.plans.views import AS_OF, Views
from gazette.sources import feeds

_CLASS = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(t, '{w}')" for w in words) + f" THEN '{c}'" for c, words in verify.CLASS_WORDS.items()) + " ELSE 'other' END"


@query("h1_classify", f"SELECT id, class, CASE class WHEN 'government_job' THEN 'job' WHEN 'other' THEN 'update' ELSE class END AS content_type FROM (SELECT id, {_CLASS} AS class FROM (SELECT id, lower(concat(CASE k % 5 WHEN 0 THEN 'Merit List of ' WHEN 1 THEN 'Hall Ticket for ' WHEN 2 THEN 'Objection window ' WHEN 3 THEN 'Notice ' ELSE 'Apply Online ' END, exam_token)) AS t FROM content_items))")
def _(v: Views) -> DataFrame:
    texts = v.content_items.select("id", F.expr("concat(case k % 5 when 0 then 'Merit List of ' when 1 then 'Hall Ticket for ' when 2 then 'Objection window ' when 3 then 'Notice ' else 'Apply Online ' end, exam_token)").alias("text"))
    return verify.classify(texts).select("id", "class", "content_type")


_HOST = r"lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1))"
_LINKS = f"""each_link AS (SELECT id, 'official_notification_url' AS field, official_notification_url AS url, base_url FROM extractions UNION ALL SELECT id, 'official_apply_url', official_apply_url, base_url FROM extractions),
link_rows AS (SELECT id, field, url, CASE WHEN NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'broken' WHEN NOT regexp_matches(lower(url), '^https?:') THEN 'suspicious' WHEN {" OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in verify.SUSPICIOUS_HOSTS)} THEN 'suspicious'
  WHEN {" OR ".join(f"ends_with(host, '{t}')" for t in verify.TRUSTED_ENDS)} OR host = shost OR ends_with(host, '.' || shost) OR ends_with(shost, '.' || host) THEN 'valid' ELSE 'unverified' END AS link_status
  FROM (SELECT *, {_HOST} AS host, {_HOST.replace('url', 'base_url')} AS shost FROM each_link WHERE url <> ''))"""


@query("h6_links", f"WITH {_LINKS} SELECT * FROM link_rows")
def _(v: Views) -> DataFrame:
    return verify.links(v.extractions, source_url="base_url")


_PLAIN = r"regexp_replace(lower({}), '[,\s\-_/]', '', 'g')"
_MONTH = "CASE substring(application_last_date, 6, 2) " + " ".join(f"WHEN '{n:02d}' THEN '{m}'" for n, m in enumerate(verify.MONTHS, 1)) + " END"
_DAY, _YEAR, _MM = "substring(application_last_date, 9, 2)", "substring(application_last_date, 1, 4)", "substring(application_last_date, 6, 2)"
_CHECK = rf"""checked AS (SELECT id, list_filter([
    CASE WHEN num <> '' AND NOT list_contains(list_transform(regexp_extract_all(source_text, '\b\d+(?:,\d+)*\b'), lambda x: replace(x, ',', '')), num) THEN {{'field': 'vacancy', 'severity': 'CRITICAL'}} END,
    CASE WHEN advertisement_number <> '' AND NOT contains(src, {_PLAIN.format('advertisement_number')}) THEN {{'field': 'advertisement_number', 'severity': 'WARNING'}} END,
    CASE WHEN application_last_date <> '' AND NOT (contains(src, {_PLAIN.format('application_last_date')}) OR contains(src, {_DAY} || {_MM} || {_YEAR}) OR contains(src, {_DAY} || {_MONTH} || {_YEAR}) OR contains(src, {_MONTH} || {_DAY} || {_YEAR})) THEN {{'field': 'application_last_date', 'severity': 'CRITICAL'}} END], lambda c: c IS NOT NULL) AS conflicts
  FROM (SELECT *, {_PLAIN.format('source_text')} AS src, replace(regexp_extract(vacancy, '\b\d+(?:,\d+)*\b'), ',', '') AS num FROM extractions))"""


@query("h3_field_verification", f"WITH {_CHECK} SELECT id, array_to_string(list_transform(conflicts, lambda c: c.field || ':' || c.severity), ',') AS conflicts FROM checked")
def _(v: Views) -> DataFrame:
    return verify.conflicts(v.extractions).select("id", F.array_join(F.transform("conflicts", lambda c: F.concat(c["field"], F.lit(":"), c["severity"])), ",").alias("conflicts"))


@query("h5_verification_rollup", f"WITH {_CHECK} SELECT id, len(conflicts) = 0 AS verified, len(list_filter(conflicts, lambda c: c.severity = 'CRITICAL')) > 0 AS critical, CASE WHEN len(list_filter(conflicts, lambda c: c.severity = 'CRITICAL')) > 0 THEN 0.4 WHEN len(conflicts) > 0 THEN 0.75 ELSE 0.98 END::DOUBLE AS confidence FROM checked")
def _(v: Views) -> DataFrame:
    return verify.conflicts(v.extractions).select("id", "verified", "critical", "confidence")


@query("h4_evidence", rf"WITH e AS (SELECT id, advertisement_number AS value, substring(source_text, 1 + k % 7, 10 + k % 30) || CASE WHEN k % 3 = 0 THEN ' invented' ELSE '' END AS evidence, {_PLAIN.format('source_text')} AS src FROM extractions), p AS (SELECT *, {_PLAIN.format('evidence')} AS pl FROM e) SELECT id, length(evidence) <= 5 OR contains(src, left(pl, 20)) OR contains(src, right(pl, 20)) OR len(list_filter(string_split(pl, ' '), lambda w: length(w) > 4 AND contains(src, w))) > 0 OR value = '' OR contains(src, {_PLAIN.format('value')}) AS authentic FROM p")
def _(v: Views) -> DataFrame:
    rows = v.extractions.selectExpr("id", "advertisement_number as value", "source_text", "concat(substring(source_text, cast(1 + k % 7 as int), cast(10 + k % 30 as int)), case when k % 3 = 0 then ' invented' else '' end) as evidence")
    return verify.evidence_found(rows).select("id", "authentic")


def scored_extractions(v: Views) -> DataFrame:
    rows = v.extractions
    found = verify.conflicts(rows).select("id", F.size(F.filter("conflicts", lambda c: c["severity"] == "CRITICAL")).alias("critical_count"), F.size(F.filter("conflicts", lambda c: c["severity"] == "WARNING")).alias("warning_count"))
    linked = verify.links(rows, source_url="base_url").groupBy("id").agg(F.count_if(F.col("link_status") == "broken").alias("broken"), F.count_if(F.col("link_status") == "suspicious").alias("suspicious"))
    return verify.quality(rows.join(found, "id").join(linked, "id", "left").fillna(0, ["broken", "suspicious"]))


_SCORED = f"""{_LINKS}, {_CHECK}, counts AS (SELECT e.*, len(list_filter(conflicts, lambda c: c.severity = 'CRITICAL')) AS cc, len(list_filter(conflicts, lambda c: c.severity = 'WARNING')) AS wc, coalesce(l.b, 0) AS b, coalesce(l.s, 0) AS s FROM extractions e JOIN checked c ON c.id = e.id
  LEFT JOIN (SELECT id, count(*) FILTER (link_status = 'broken') AS b, count(*) FILTER (link_status = 'suspicious') AS s FROM link_rows GROUP BY id) l ON l.id = e.id),
graded AS (SELECT id, cc, least(100, greatest(0, CASE WHEN trust_level IS NULL THEN 20 ELSE least(greatest(trust_level, 1), 5) * 6 END
  + least(20, 4 * ((coalesce(post_name, '') <> '')::INT + (title <> '')::INT + (vacancy <> '')::INT + (application_last_date <> '')::INT + (official_notification_url <> '')::INT + (coalesce(official_apply_url, '') <> '')::INT))
  + CASE WHEN evidence_count >= 3 THEN 20 WHEN evidence_count = 2 THEN 15 WHEN evidence_count = 1 THEN 10 ELSE 0 END + greatest(0, 15 - 10 * b - 10 * s) + CASE WHEN cc > 0 THEN 0 ELSE greatest(0, 15 - 5 * wc) END)) AS total_score FROM counts)"""


@query("h7_quality", f"WITH {_SCORED} SELECT id, total_score, CASE WHEN cc > 0 THEN 'review_required' WHEN total_score >= 90 THEN 'auto_publish_eligible' WHEN total_score >= 75 THEN 'review_required' ELSE 'rejected' END AS eligibility FROM graded")
def _(v: Views) -> DataFrame:
    return scored_extractions(v).select("id", "total_score", "eligibility")


@query("h8_publish_decision", f"WITH {_SCORED} SELECT id, CASE WHEN cc = 0 AND total_score >= 90 THEN 'published' ELSE 'review' END AS decision FROM graded")
def _(v: Views) -> DataFrame:
    return verify.publish_decision(scored_extractions(v), gate="quality").select("id", "decision")


@query("h9_field_changes", """WITH n AS (SELECT id, CASE WHEN k % 4 = 0 THEN concat(vacancy, '0') ELSE vacancy END AS vacancy, CASE WHEN k % 5 = 0 THEN NULL ELSE application_last_date END AS application_last_date FROM extractions)
SELECT o.id, (o.vacancy IS DISTINCT FROM n.vacancy)::INT + (o.application_last_date IS DISTINCT FROM n.application_last_date)::INT AS n_changes,
  concat('**Important Update:**', chr(10), concat_ws(chr(10), CASE WHEN o.application_last_date IS DISTINCT FROM n.application_last_date THEN concat('- Field "application_last_date" changed from "', coalesce(o.application_last_date, 'N/A'), '" to "', coalesce(n.application_last_date, 'N/A'), '".') END,
  CASE WHEN o.vacancy IS DISTINCT FROM n.vacancy THEN concat('- Field "vacancy" changed from "', coalesce(o.vacancy, 'N/A'), '" to "', coalesce(n.vacancy, 'N/A'), '".') END)) AS summary
FROM extractions o JOIN n ON n.id = o.id WHERE o.vacancy IS DISTINCT FROM n.vacancy OR o.application_last_date IS DISTINCT FROM n.application_last_date""")
def _(v: Views) -> DataFrame:
    old = v.extractions.select("id", "k", "vacancy", "application_last_date")
    new = old.selectExpr("id", "case when k % 4 = 0 then concat(vacancy, '0') else vacancy end as vacancy", "case when k % 5 <> 0 then application_last_date end as application_last_date")
    return verify.field_changes(old, new).select("id", F.size("changes").alias("n_changes"), "summary")


@query("e7_versions", "WITH old AS (SELECT concat('ci_', k % 50) AS content_item_id, max(k DIV 50) AS last FROM content_items WHERE k % 3 <> 0 GROUP BY 1) SELECT i.id, concat('ci_', i.k % 60) AS content_item_id, coalesce(o.last, 0) + row_number() OVER (PARTITION BY i.k % 60 ORDER BY i.created_at, i.id) AS version FROM content_items i LEFT JOIN old o ON o.content_item_id = concat('ci_', i.k % 60) WHERE i.k % 2 = 0")
def _(v: Views) -> DataFrame:
    existing = v.content_items.where("k % 3 <> 0").selectExpr("concat('ci_', k % 50) as content_item_id", "k div 50 as version")
    new = v.content_items.where("k % 2 = 0").selectExpr("id", "concat('ci_', k % 60) as content_item_id", "created_at")
    return verify.next_versions(existing, new, ["created_at", "id"]).select("id", "content_item_id", "version")


@query("h10_internal_links", PUBLIC + f""", f AS (SELECT id, type, organization_id, category_id, nullif(lower(trim(post_name)), '') AS post, qualification, published_at FROM public),
s AS (SELECT a.id AS a_id, b.id AS b_id, b.published_at AS pub, CASE WHEN a.organization_id = b.organization_id THEN 40 ELSE 0 END + CASE WHEN contains(a.post, b.post) OR contains(b.post, a.post) THEN 35 ELSE 0 END + CASE WHEN a.category_id = b.category_id THEN 25 ELSE 0 END
  + CASE WHEN {" OR ".join(f"(contains(lower(a.qualification), '{q}') AND contains(lower(b.qualification), '{q}'))" for q in verify.LEVELS)} THEN 15 ELSE 0 END
  + CASE WHEN (a.type = 'job' AND b.type IN ('result', 'admit_card', 'answer_key')) OR (b.type = 'job' AND a.type IN ('result', 'admit_card', 'answer_key')) THEN 15 ELSE 0 END + CASE WHEN b.published_at <= TIMESTAMP '{AS_OF}' AND b.published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY THEN 5 ELSE 0 END AS score
  FROM f a JOIN f b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY score DESC, pub DESC NULLS LAST, b_id) AS rank FROM s WHERE score >= 20) SELECT a_id, b_id, score, rank::INT AS rank FROM r WHERE rank <= 6""")
def _(v: Views) -> DataFrame:
    return verify.internal_links(public(v), AS_OF)


@query("h14_decisions", f"WITH last AS (SELECT item_id, arg_max(action, (ts, seq)) AS action FROM decisions GROUP BY 1) SELECT i.id, CASE action WHEN 'approve' THEN 'published' WHEN 'draft' THEN 'draft' WHEN 'reject' THEN 'archived' ELSE status END AS status, CASE WHEN action = 'approve' THEN coalesce(published_at, TIMESTAMP '{AS_OF}') ELSE published_at END AS published_at FROM content_items i LEFT JOIN last ON item_id = i.id")
def _(v: Views) -> DataFrame:
    return verify.decided(v.content_items, v.decisions, AS_OF).select("id", "status", "published_at")


@query("h14_user_decisions", "WITH last AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM {events} WHERE event_type IN ('error', 'purchase') GROUP BY 1) SELECT id, CASE event_type WHEN 'error' THEN 'suspended' WHEN 'purchase' THEN 'active' ELSE status END AS status FROM users LEFT JOIN last ON id = concat('u_', user_id)")
def _(v: Views) -> DataFrame:
    """An error has its user suspended, a purchase has it active again."""
    decisions = v.raw("events").selectExpr("concat('u_', user_id) as user_id", "case event_type when 'error' then 'suspend' when 'purchase' then 'activate' else 'view' end as action", "ts", "event_id as seq")
    return verify.decided_users(v.users, decisions).select("id", "status")


@query("h14_error_decisions", "SELECT id, resolved OR EXISTS (SELECT 1 FROM {events} e WHERE e.event_type = 'click' AND e.event_id = l.id + 1) AS resolved FROM error_logs l")
def _(v: Views) -> DataFrame:
    """A click that follows an error at once resolves it."""
    decisions = v.raw("events").where("event_type = 'click'").selectExpr("event_id - 1 as error_id")
    return verify.resolved_errors(v.error_logs, decisions).select("id", "resolved")


@query("h15_bulk_publish", f"SELECT id, CASE WHEN status = 'draft' OR (status = 'archived' AND auto_publish_eligible) THEN 'published' ELSE status END AS status, CASE WHEN status = 'draft' OR (status = 'archived' AND auto_publish_eligible) THEN coalesce(published_at, TIMESTAMP '{AS_OF}') ELSE published_at END AS published_at FROM content_items")
def _(v: Views) -> DataFrame:
    return verify.published_in_bulk(v.content_items, AS_OF).select("id", "status", "published_at")


_OF_USERS = ("saved_items", "followed_organizations", "followed_categories", "notifications", "subscriptions")
_KEPT = "user_id NOT IN (SELECT id FROM users WHERE status = 'suspended')"


@query("h16_erasure", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows, " + ("count(*) FILTER (content_item_id NOT IN (SELECT id FROM content_items WHERE status = 'archived'))" if t == "notifications" else "count(*)") + f" AS with_item FROM {t} WHERE {_KEPT}" + (" AND content_item_id NOT IN (SELECT id FROM content_items WHERE status = 'archived')" if t == "saved_items" else "") for t in _OF_USERS))
def _(v: Views) -> DataFrame:
    """Suspended users go with all that is theirs; archived items go from the saved ones, and notifications forget them."""
    tables = {t: getattr(v, t) for t in _OF_USERS}
    left = verify.erased(tables, v.users.where("status = 'suspended'").select("id"), dict.fromkeys(_OF_USERS, "user_id"), {})
    left = verify.erased(left, v.content_items.where("status = 'archived'").select("id"), {"saved_items": "content_item_id"}, {"notifications": "content_item_id"})
    counts = [left[t].agg(F.lit(t).alias("name"), F.count("*").alias("rows"), F.count("content_item_id" if t == "notifications" else "*").alias("with_item")) for t in _OF_USERS]
    return reduce(DataFrame.unionByName, counts)


@query("e13_budget", "SELECT id, d <= 300 AND m <= 5000 AS admitted FROM (SELECT id, row_number() OVER (PARTITION BY created_at::DATE ORDER BY created_at, id) AS d, row_number() OVER (PARTITION BY date_trunc('month', created_at) ORDER BY created_at, id) AS m FROM ai_generations)")
def _(v: Views) -> DataFrame:
    return verify.within_budget(v.ai_generations, 300, 5000).select("id", "admitted")


_PAGES = "rows AS (SELECT k, CASE WHEN k % 23 = 0 THEN 'NOINDEX' WHEN k % 29 = 0 THEN 'all' ELSE '' END AS explicit, status, k % 17 = 0 AS preview, CASE k % 6 WHEN 0 THEN '/admin/x' WHEN 1 THEN '/search' WHEN 2 THEN '/404' ELSE '/jobs/a' END AS path, k % 4 AS n_params, k % 5 = 0 AS asked, k % 3 AS total, 1 + k % 2 AS least FROM content_items)"


@query("b12_index_directive", f"WITH {_PAGES} SELECT k, CASE WHEN explicit = 'NOINDEX' THEN 'noindex, follow' WHEN explicit <> '' THEN 'index, follow' WHEN preview OR status <> 'published' THEN 'noindex, follow' WHEN path IN ('/admin/x', '/404') THEN 'noindex, nofollow' WHEN path = '/search' AND asked THEN 'noindex, follow' WHEN n_params + asked::INT >= 3 THEN 'noindex, follow' WHEN total < least THEN 'noindex, follow' ELSE 'index, follow' END AS directive FROM rows")
def _(v: Views) -> DataFrame:
    rows = v.content_items.selectExpr(
        "k", "case when k % 23 = 0 then 'NOINDEX' when k % 29 = 0 then 'all' else '' end as explicit", "status", "k % 17 = 0 as preview", "case k % 6 when 0 then '/admin/x' when 1 then '/search' when 2 then '/404' else '/jobs/a' end as path",
        "map_from_entries(filter(array(struct('page' as key, '2' as value), if(k % 4 >= 1, struct('a' as key, 'x' as value), null), if(k % 4 >= 2, struct('b' as key, 'x' as value), null), if(k % 4 >= 3, struct('c' as key, 'x' as value), null), struct('d' as key, 'all' as value), if(k % 5 = 0, struct('q' as key, 'text' as value), null)), x -> x is not null)) as params",
        "k % 3 as total", "1 + k % 2 as least",
    )
    return rows.select("k", verify.index_directive(*[F.col(c) for c in ("explicit", "status", "preview", "path", "params", "total", "least")]).alias("directive"))


_ROUTED = "CASE WHEN k % 3 = 0 THEN concat('/jobs/', slug) WHEN k % 3 = 1 THEN concat('https://www.example.org/results/', slug) ELSE '/jobs' END"


@query("b13_may_submit", f"SELECT id, CASE WHEN k % 4 = 0 THEN type = 'job' ELSE regexp_matches({_ROUTED}, '^/jobs(/|$)') END AS eligible FROM content_items")
def _(v: Views) -> DataFrame:
    rows = v.content_items.selectExpr("id", f"{_ROUTED.lower()} as url", "case when k % 4 = 0 then type end as content_type")
    return rows.select("id", verify.may_submit(F.col("url"), F.col("content_type")).alias("eligible"))


@query("b14_safe_urls", "SELECT page_id, CASE page_id % 6 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN false ELSE regexp_matches(lower(url), '^https?://') END AS safe FROM {pages}")
def _(v: Views) -> DataFrame:
    rows = v.raw("pages").selectExpr("page_id", "case page_id % 6 when 0 then 'http://127.0.0.1/a' when 1 then 'javascript:alert(1)' when 2 then 'http://172.20.1.5:80/x' else url end as url")
    return rows.select("page_id", verify.safe_url(F.col("url")).alias("safe"))


@query("b11_robots", "SELECT page_id, path, starts_with(path, '/en/10') OR NOT (starts_with(path, '/en/1') OR regexp_matches(path, '^/.*\\.html')) AS allowed FROM page_paths")
def _(v: Views) -> DataFrame:
    body = "User-agent: *\nDisallow: /en/1 # private\nAllow: /en/10\nDisallow: /*.html\nUser-agent: other\nDisallow: /"
    urls = v.page_paths.select("page_id", "path", F.lit("https://example.org").alias("origin"))
    files = urls.select("origin").distinct().withColumn("body", F.lit(body))
    return verify.robots_allowed(urls, verify.robots_rules(files)).select("page_id", "path", "allowed")


@query("g20_null_cleaning", "SELECT id, CASE WHEN lower(trim(x)) IN ('', 'null', 'n/a', 'not mentioned', 'none', 'undefined') THEN NULL ELSE trim(x) END AS cleaned, try_cast(nullif(regexp_replace(x, '[^0-9.]', '', 'g'), '') AS DOUBLE) AS number, least(greatest(c, 0.0), 1.0) AS confidence FROM (SELECT id, CASE k % 5 WHEN 0 THEN ' N/A ' WHEN 1 THEN concat('Rs ', k, '.50') WHEN 2 THEN 'None' WHEN 3 THEN ' text ' ELSE '' END AS x, CAST(k % 7 - 2 AS DOUBLE) / 3 AS c FROM content_items)")
def _(v: Views) -> DataFrame:
    rows = v.content_items.selectExpr("id", "case k % 5 when 0 then ' N/A ' when 1 then concat('Rs ', k, '.50') when 2 then 'None' when 3 then ' text ' else '' end as x", "cast(k % 7 - 2 as double) / 3 as c")
    return rows.select("id", exprs.without_no_value(F.col("x")).alias("cleaned"), exprs.number_of(F.col("x")).alias("number"), exprs.clamped(F.col("c")).alias("confidence"))


def sql_encoded(x: str) -> str:
    """Percent-encoding of a path but for slashes and marks that stay."""
    out = f"url_encode({x})"
    for code, char in (("%2F", "/"), ("%2C", ","), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%21", "!"), ("%2A", "*"), ("%3A", ":"), ("%3B", ";"), ("%40", "@"), ("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%3D", "="), ("%25", "%")):
        out = f"replace({out}, '{code}', '{char}')"
    return out


def sql_params(u: str, tracking: tuple[str, ...]) -> str:
    """A URL's parameters without tracking ones, sorted, after a question mark."""
    kept = f"list_filter(string_split(regexp_extract({u}, '^[^?#]*[?]([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^({'|'.join(tracking)})(=|$)'))"
    return f"coalesce('?' || nullif(array_to_string(list_sort(list_transform({kept}, lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END)), '&'), ''), '')"


def sql_url(u: str) -> str:
    """The normalized form of an absolute URL without a port."""
    path = f"regexp_extract({u}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
    plain = f"CASE WHEN length({path}) > 1 THEN regexp_replace({path}, '/$', '') WHEN {path} = '' THEN '/' ELSE {path} END"
    return f"lower(regexp_extract({u}, '^[A-Za-z]+://[^/?#]*')) || {sql_encoded(plain)} || {sql_params(u, text.TRACKING)}"


#: Links of a page, resolved: absolute, from the site's root, or from the page's folder.
SQL_LINKS = r"""anchors AS (SELECT page_id, url AS base, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 1)) AS href, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 2)) AS label, generate_subscripts(regexp_extract_all(html, '(?is)<a\s[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 1), 1)::INT AS pos FROM {pages}),
links AS (SELECT page_id, pos, href, label, CASE WHEN regexp_matches(href, '^(?i)https?://') THEN href WHEN starts_with(href, '/') THEN regexp_extract(base, '^[A-Za-z]+://[^/?#]*') || href ELSE regexp_extract(base, '^([A-Za-z]+://[^/?#]*(/[^?#]*)?)/', 1) || '/' || href END AS resolved
  FROM anchors WHERE NOT regexp_matches(lower(trim(href)), '^(#|javascript:|mailto:|tel:|data:|sms:|whatsapp:|tg:|file:|ftp:)'))"""


@query("g1_normalized_urls", f"SELECT {sql_url('url')} AS normalized_url, min(page_id) AS first_page, count(*) AS pages FROM {{pages}} GROUP BY 1")
def _(v: Views) -> DataFrame:
    pages = v.raw("pages").select("page_id", text.normalize_url(F.col("url")).alias("normalized_url"))
    return pages.groupBy("normalized_url").agg(F.min("page_id").alias("first_page"), F.count("*").alias("pages"))


@query("g2_resolved_links", f"WITH {SQL_LINKS} SELECT page_id, min(pos) AS pos, arg_min(resolved, pos) AS resolved FROM links GROUP BY page_id, {sql_url('resolved')}")
def _(v: Views) -> DataFrame:
    return feeds.html_links(v.raw("pages")).select("page_id", "pos", F.col("url").alias("resolved"))


@query("a2_link_discovery", f"WITH {SQL_LINKS}, named AS (SELECT *, {sql_url('resolved')} AS normalized_url, row_number() OVER (PARTITION BY page_id, {sql_url('resolved')} ORDER BY pos) AS nth FROM links) SELECT page_id, pos, href, normalized_url, trim(regexp_replace(regexp_replace(label, '<[^>]+>', ' ', 'g'), '[\\s ]+', ' ', 'g')) AS anchor, regexp_matches(lower(resolved), '\\.pdf([?#]|$)') AS is_pdf FROM named WHERE nth = 1")
def _(v: Views) -> DataFrame:
    return feeds.html_links(v.raw("pages")).select("page_id", "pos", "href", "normalized_url", "anchor", "is_pdf")


@query("g3_site_urls", f"SELECT page_id, 'https://www.example.org' || CASE WHEN p = '' THEN '/' WHEN length(p) > 1 THEN rtrim(p, '/') ELSE p END || {sql_params('url', text.SITE_TRACKING)} AS canonical_url FROM (SELECT page_id, url, lower(regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g')) AS p FROM {{pages}})")
def _(v: Views) -> DataFrame:
    return v.raw("pages").select("page_id", text.canonical_site_url(F.col("url"), "www.example.org").alias("canonical_url"))


@query("g6_normalized_text")
def _(v: Views) -> DataFrame:
    return v.raw("documents").select("doc_id", F.sha2(text.normalize_any_text(F.col("text")), 256).alias("normalized_sha256"))


@query("g19_masked_metadata")
def _(v: Views) -> DataFrame:
    return v.error_logs.select("id", text.mask_secrets(F.col("metadata")).alias("metadata"))


@query("g16_titles", PUBLIC + """SELECT id, substring(CASE type WHEN 'job' THEN concat(coalesce(organization_name, 'Govt'), ' ', coalesce(post_name, title), ' Recruitment 2024 — ', CASE WHEN coalesce(vacancy, '') <> '' THEN concat(vacancy, ' Vacancies, ') ELSE '' END, 'Eligibility & Apply Online') WHEN 'result' THEN concat(title, ' — Check Result, Merit List & Cut Off Marks') WHEN 'admit_card' THEN concat(title, ' — Download Hall Ticket & Exam Schedule')
  WHEN 'answer_key' THEN concat(title, ' — Download Solution Key & Raise Objections') WHEN 'exam' THEN concat(title, ' — Exam Dates, Schedule & Shift Timing Calendar') WHEN 'scholarship' THEN concat(title, ' 2024 — Eligibility, Grant Amount & Apply Online') WHEN 'scheme' THEN concat(title, ' — Guidelines, Eligibility & Registration Process') ELSE concat(title, ' — Official Government Notice & Circular') END, 1, 100) AS page_title FROM public""")
def _(v: Views) -> DataFrame:
    return public(v).select("id", templates.page_title(*[F.col(c) for c in ("type", "title", "organization_name", "post_name", "vacancy")], 2024).alias("page_title"))


@query("g22_questions", "SELECT id, (vacancy <> '')::INT + (application_last_date <> '')::INT AS n, CASE WHEN application_last_date <> '' THEN concat('The last date to submit the application is ', application_last_date, '.') WHEN vacancy <> '' THEN concat('A total of ', vacancy, ' vacancies have been notified.') END AS first_answer FROM extractions")
def _(v: Views) -> DataFrame:
    faq = templates.questions(["application_last_date", "vacancy"])
    return v.extractions.withColumn("faq", faq).select("id", F.size("faq").alias("n"), F.get(F.col("faq"), F.lit(0))["answer"].alias("first_answer"))


@query("g21_sections", "SELECT id, title AS overview, concat('Total ', k) AS vacancy_details FROM content_items")
def _(v: Views) -> DataFrame:
    rows = v.content_items.select("id", F.expr("concat('# x\\n## Overview\\n', title, '\\n\\n## Vacancy Details\\nTotal ', k, '\\n## FAQ\\n')").alias("markdown"))
    return rows.select("id", *templates.sections(F.col("markdown"))).select("id", "overview", "vacancy_details")


@query("h2_parsed_responses")
def _(v: Views) -> DataFrame:
    made = v.extractions.select("id", F.expr("concat('```json\\n{\"title\": \"', title, '\", \"vacancy\": \"', if(k % 3 = 0, 'N/A', vacancy), '\", \"confidence\": 1.', k % 5, ',}\\n```')").alias("response"))
    return verify.parsed_responses(made)[0].select("id", "title", "vacancy", "confidence")


@query("h11_injected_links")
def _(v: Views) -> DataFrame:
    best = verify.internal_links(public(v), AS_OF, n=3)
    facts = public(v).select(F.col("id").alias("b_id"), F.coalesce("post_name", "title").alias("anchor"), exprs.target_url(F.col("type"), F.col("slug")).alias("url"))
    anchors = best.join(facts, "b_id").groupBy(F.col("a_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "anchor", "url"))), lambda x: F.struct(x["anchor"].alias("anchor"), x["url"].alias("url"))).alias("anchors"))
    bodies = public(v).select("id", F.concat("title", F.lit(". See also Clerk, NTPC and Officer posts.")).alias("body"))
    return bodies.join(anchors, "id").select("id", text.inject_links(F.col("body"), F.col("anchors")).alias("body"))
