"""Queries over entity resolution and column expressions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.functions import exprs
from gazette.operators import resolve
from gazette.plans.listing_queries import STATUS
from gazette.plans.registry import query
from gazette.plans.views import AS_OF, Views
from gazette.session import written

def sql_norm(x: str) -> str:
    """normalize_text for ASCII text."""
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^A-Za-z0-9_\s\-/. ]', ' ', 'g'), '\s+', ' ', 'g'))"


def sql_organization(x: str) -> str:
    whens = " ".join(rf"WHEN regexp_matches({sql_norm(x)}, '\b{a}\b') THEN '{full}'" for a, full in exprs.ORGANIZATION_ALIASES.items())
    return f"CASE {whens} ELSE {sql_norm(x)} END"


def sql_recruitment(x: str) -> str:
    text = sql_norm(x)
    for alias, full in exprs.EXAM_ALIASES.items():
        text = rf"regexp_replace({text}, '\b{alias}\b', '{full}')"
    return text


def sql_in_title(x: str, patterns: dict) -> str:
    whens = " ".join(rf"WHEN regexp_matches({sql_norm(x)}, '\b({p})\b') THEN '{name}'" for p, name in patterns.items())
    return f"CASE {whens} END"


def sql_number(x: str) -> str:
    kept = rf"regexp_replace(regexp_replace({sql_norm(x)}, '\b({exprs.NOTICE_WORDS})\b', '', 'g'), '[^A-Za-z0-9_/]', '', 'g')"
    return f"CASE WHEN length({kept}) >= 2 THEN {kept} END"


NOTICES = "notices AS (SELECT i.id, i.type, i.title, i.advertisement_number, j.vacancy, j.application_start, j.application_last_date, j.official_notification_url, i.created_at, i.k, i.status FROM content_items i LEFT JOIN jobs j ON j.content_item_id = i.id WHERE i.status <> 'archived')"
IDENT = f"""ident AS (
  SELECT id, type AS content_type, coalesce(try_cast(nullif(regexp_extract(title, '\\b(202[0-9]|203[0-9])\\b', 1), '') AS INT), 2024) AS year, {sql_organization('raw_org')} AS org0, raw_org, {sql_recruitment('raw_rec')} AS rec0, raw_rec,
    {sql_number('advertisement_number')} AS advt, official_notification_url AS pdf, CASE WHEN v > 0 THEN v END AS vacancy, strftime(application_last_date, '%Y-%m-%d %H:%M:%S') AS ends, {sql_norm('title')} AS norm, created_at, k
  FROM (SELECT *, {sql_in_title('title', exprs.TITLE_ORGANIZATIONS)} AS raw_org, {sql_in_title('title', exprs.TITLE_EXAMS)} AS raw_rec, try_cast(nullif(regexp_replace(vacancy, '[^0-9]', '', 'g'), '') AS BIGINT) AS v FROM notices)),
ids AS (SELECT *, CASE WHEN raw_org IS NOT NULL THEN org0 END AS org, CASE WHEN raw_rec IS NOT NULL THEN rec0 END AS rec, list_distinct(list_filter(string_split(norm, ' '), lambda w: length(w) > 1)) AS toks FROM ident)"""
SCORE = """sim AS (SELECT *, CASE WHEN a_norm = b_norm THEN 1.0 WHEN len(a_toks) = 0 OR len(b_toks) = 0 THEN 0.0 ELSE len(list_intersect(a_toks, b_toks))::DOUBLE / (len(a_toks) + len(b_toks) - len(list_intersect(a_toks, b_toks))) END AS title_similarity FROM pairs),
points AS (SELECT *, CASE WHEN a_rec <> b_rec THEN 'recruitment_name' END AS guard, CASE WHEN a_advt = b_advt THEN 98 WHEN a_pdf = b_pdf THEN 96 END AS exact,
  list_filter([CASE WHEN a_vacancy <> b_vacancy THEN 'vacancy' END, CASE WHEN a_ends <> b_ends THEN 'application_end' END], lambda x: x IS NOT NULL) AS clash,
  greatest(0, least(100, CASE WHEN a_org = b_org THEN 35 ELSE 0 END + CASE WHEN a_org = b_org AND a_rec = b_rec THEN 35 ELSE 0 END + 15 + floor(title_similarity * 20 + 0.5)::INT
    + CASE WHEN a_vacancy = b_vacancy THEN 10 WHEN a_vacancy <> b_vacancy THEN -15 ELSE 0 END + CASE WHEN a_ends = b_ends THEN 10 WHEN a_ends <> b_ends THEN -10 ELSE 0 END)) AS summed FROM sim),
graded AS (SELECT *, CASE WHEN guard IS NOT NULL THEN 0 ELSE coalesce(exact, summed) END AS confidence, CASE WHEN guard IS NOT NULL THEN [guard] WHEN exact IS NOT NULL THEN [] ELSE clash END AS conflicts FROM points),
tiers AS (SELECT *, CASE WHEN guard IS NOT NULL THEN 'WEAK' WHEN confidence >= 95 THEN 'EXACT' WHEN confidence >= 85 THEN 'HIGH_CONFIDENCE' WHEN confidence >= 50 OR (len(conflicts) > 0 AND title_similarity >= 0.3) THEN 'POSSIBLE' ELSE 'WEAK' END AS tier FROM graded),
scored AS (SELECT *, CASE WHEN tier = 'EXACT' THEN 'canonical' WHEN tier = 'HIGH_CONFIDENCE' THEN CASE WHEN len(conflicts) > 0 THEN 'review_required' ELSE 'canonical' END WHEN tier = 'POSSIBLE' THEN 'review_required' ELSE 'unique' END AS status FROM tiers)"""
_FIELDS = ("id", "content_type", "year", "org", "rec", "advt", "pdf", "vacancy", "ends", "norm", "toks", "created_at")


def _pairs(a: str, b: str, on: str, more: tuple[str, ...] = ()) -> str:
    columns = ", ".join(f"{s}.{f} AS {s}_{f}" for s in ("a", "b") for f in (*_FIELDS, *more))
    return f"pairs AS (SELECT {columns} FROM {a} a JOIN {b} b ON a.content_type = b.content_type AND a.year = b.year AND {on})"


AUDIT = f"WITH {NOTICES}, {IDENT}, {_pairs('ids', 'ids', 'a.id < b.id')}, {SCORE}, audit AS (SELECT * FROM scored WHERE confidence >= 65) "


def notices(v: Views) -> DataFrame:
    jobs = v.jobs.select("content_item_id", "vacancy", "application_start", "application_last_date", "official_notification_url")
    items = v.content_items.where("status <> 'archived'").select("id", "type", "title", "advertisement_number", "created_at", "k", "status")
    return items.join(jobs, F.col("id") == F.col("content_item_id"), "left").drop("content_item_id")


@query("r1_identities", f"WITH {NOTICES}, {IDENT} SELECT id, content_type, year, org, rec, advt, pdf, vacancy::VARCHAR AS vacancy, ends, norm FROM ids")
def _(v: Views) -> DataFrame:
    return resolve.identities(notices(v), AS_OF).select("id", "content_type", "year", "org", "rec", "advt", "pdf", F.col("vacancy").cast("string").alias("vacancy"), "ends", "norm")


_OUT = "a_id, b_id, confidence, tier, status, array_to_string(conflicts, ',') AS conflicts, round(title_similarity, 6) AS title_similarity"


@query("r4_duplicate_audit", AUDIT + f"SELECT {_OUT} FROM audit")
def _(v: Views) -> DataFrame:
    shown = {"conflicts": F.array_join("conflicts", ","), "title_similarity": F.round("title_similarity", 6)}
    return resolve.duplicate_audit(notices(v), AS_OF, shown=shown).select("a_id", "b_id", "confidence", "tier", "status", "conflicts", "title_similarity")


@query("d13_audit_statistics", AUDIT + "SELECT (SELECT count(*) FROM notices) AS scanned, count(*) AS pairs, count(*) FILTER (confidence >= 85) AS high, count(*) FILTER (confidence BETWEEN 65 AND 84) AS review, (SELECT count(*) FROM notices WHERE id NOT IN (SELECT a_id FROM audit UNION ALL SELECT b_id FROM audit)) AS unpaired, (SELECT count(*) FROM notices) - count(*) AS scanned_less_pairs FROM audit")
def _(v: Views) -> DataFrame:
    return resolve.audit_statistics(notices(v), AS_OF)


@query("c11_pair_enrichment", AUDIT + "SELECT a_id, b_id, confidence, a.title AS a_title, b.title AS b_title FROM audit JOIN content_items a ON a.id = a_id LEFT JOIN content_items b ON b.id = b_id WHERE audit.status = 'review_required' ORDER BY confidence DESC, a_id, b_id LIMIT 50")
def _(v: Views) -> DataFrame:
    top = resolve.first_pairs(notices(v), AS_OF, "review_required", 50).select("a_id", "b_id", "confidence")
    items = v.content_items
    return top.join(items.selectExpr("id as a_id", "title as a_title"), "a_id").join(items.selectExpr("id as b_id", "title as b_title"), "b_id", "left")


_LABELLED = "labelled AS (SELECT *, min(id) OVER same AS class, count(*) OVER same AS n FROM ids WINDOW same AS (PARTITION BY content_type, year, org, rec, advt, pdf, vacancy, ends, norm))"


@query("r4_audit_classes", AUDIT.rstrip() + f""", {_LABELLED}
SELECT least(a.class, b.class) AS a_class, greatest(a.class, b.class) AS b_class, any_value(CASE WHEN a.class <= b.class THEN a.n ELSE b.n END) AS a_n, any_value(CASE WHEN a.class <= b.class THEN b.n ELSE a.n END) AS b_n, count(*) AS pairs, any_value(confidence) AS confidence, any_value(tier) AS tier, any_value(status) AS status
FROM audit JOIN labelled a ON a.id = a_id JOIN labelled b ON b.id = b_id GROUP BY 1, 2""")
def _(v: Views) -> DataFrame:
    """The audit by classes, each named by its least member."""
    rows = resolve.audit_pairs(resolve.audit_classes(notices(v), AS_OF)[0])
    turned = F.col("a_name") > F.col("b_name")
    pick = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    return rows.select(pick("a_name", "b_name").alias("a_class"), pick("b_name", "a_name").alias("b_class"), pick("a_n", "b_n").alias("a_n"), pick("b_n", "a_n").alias("b_n"), "pairs", "confidence", "tier", "status")


_TITLED = "titled AS (SELECT *, min(id) OVER (PARTITION BY content_type, year, org, rec, norm) AS title FROM ids)"


@query("r4_audit_titles", AUDIT.rstrip() + f", {_TITLED} SELECT least(a.title, b.title) AS a_title, greatest(a.title, b.title) AS b_title, confidence, tier, status, count(*) AS pairs FROM audit JOIN titled a ON a.id = a_id JOIN titled b ON b.id = b_id GROUP BY ALL")
def _(v: Views) -> DataFrame:
    """The audit by titles, each named by its least member, with the number of pairs of each score."""
    outcomes, members = resolve.audit_titles(notices(v), AS_OF)
    names = members.groupBy("title").agg(F.min("id").alias("name"))
    for side in ("a", "b"):
        outcomes = outcomes.join(names.select(F.col("title").alias(f"{side}_title"), F.col("name").alias(f"{side}_name")), f"{side}_title")
    return outcomes.select(F.least("a_name", "b_name").alias("a_title"), F.greatest("a_name", "b_name").alias("b_title"), "confidence", "tier", "status", "pairs")


@query("r4_audit_members", f"WITH {NOTICES}, {IDENT}, {_LABELLED} SELECT id, class, n FROM labelled")
def _(v: Views) -> DataFrame:
    members = written(resolve.audit_members(notices(v), AS_OF), "audit-members")
    return members.join(members.groupBy("class").agg(F.min("id").alias("name"), F.count("*").alias("n")), "class").select("id", F.col("name").alias("class"), "n")


@query("r9_related_stages", f"WITH {NOTICES}, {IDENT} SELECT a.id AS a_id, b.id AS b_id, a.content_type AS a_content_type, b.content_type AS b_content_type FROM ids a JOIN ids b ON a.org = b.org AND a.rec = b.rec AND a.year = b.year AND a.content_type < b.content_type")
def _(v: Views) -> DataFrame:
    return resolve.related_stages(notices(v), AS_OF)


_STAGED = "staged AS (SELECT *, min(id) OVER same AS class, count(*) OVER same AS n FROM ids WHERE org IS NOT NULL AND rec IS NOT NULL WINDOW same AS (PARTITION BY org, rec, year, content_type))"


@query("r9_stage_classes", f"WITH {NOTICES}, {IDENT}, {_STAGED}, classes AS (SELECT DISTINCT class, org, rec, year, content_type, n FROM staged) SELECT a.class AS a_class, b.class AS b_class, a.org, a.rec, a.year, a.content_type AS a_content_type, b.content_type AS b_content_type, a.n AS a_n, b.n AS b_n, a.n * b.n AS pairs FROM classes a JOIN classes b ON a.org = b.org AND a.rec = b.rec AND a.year = b.year AND a.content_type < b.content_type")
def _(v: Views) -> DataFrame:
    """A row for each pair of types of an organization, recruitment and year; a class is named by its least member."""
    pairs, members = resolve.stage_classes(notices(v), AS_OF)
    names = members.groupBy("class").agg(F.min("id").alias("name"))
    for side in ("a", "b"):
        pairs = pairs.join(names.select(F.col("class").alias(f"{side}_class"), F.col("name").alias(f"{side}_name")), f"{side}_class").drop(f"{side}_class").withColumnRenamed(f"{side}_name", f"{side}_class")
    return pairs.withColumn("pairs", F.col("a_n") * F.col("b_n"))


_KIND = "CASE WHEN regexp_matches(host, '\\.(gov|nic|ac)\\.in$') OR contains(host, 'upsc.gov') OR contains(host, 'ssc.nic') OR contains(host, 'rrbcdg.gov') THEN 'official_government' WHEN contains(host, 'employmentnews') OR contains(host, 'ncs.gov') OR contains(host, 'pib.gov') THEN 'government_publication' WHEN contains(host, 'sarkari') OR contains(host, 'result') OR contains(host, 'freejobalert') OR contains(host, 'jagranjosh') THEN 'established_aggregator' ELSE 'discovery_source' END"
_SEEN = "seen AS (SELECT concat('ci_', k % 300) AS item_id, concat(s.base_url, '/p/', k) AS url, k % 3 = 0 AS has_pdf, k % 4 = 0 AS has_apply_url, k % 5 = 0 AS is_recent, created_at AS discovered_at FROM content_items i JOIN sources s ON s.id = i.source_id)"
_RATED = f"rated AS (SELECT *, CASE source_type WHEN 'official_government' THEN 100 WHEN 'government_publication' THEN 80 WHEN 'established_aggregator' THEN 60 ELSE 30 END + CASE WHEN has_pdf THEN 30 ELSE 0 END + CASE WHEN has_apply_url THEN 20 ELSE 0 END + CASE WHEN is_recent THEN 10 ELSE 0 END AS score FROM (SELECT *, {_KIND} AS source_type FROM (SELECT *, lower(regexp_extract(url, '://([^/:?#]+)', 1)) AS host FROM seen)))"


def rated_sources(v: Views) -> DataFrame:
    seen = v.content_items.join(v.sources.selectExpr("id as source_id", "base_url"), "source_id").selectExpr("concat('ci_', k % 300) as item_id", "concat(base_url, '/p/', k) as url", "k % 3 = 0 as has_pdf", "k % 4 = 0 as has_apply_url", "k % 5 = 0 as is_recent", "created_at as discovered_at")
    return resolve.authority(seen)


@query("r7_canonical_sources", f"WITH {_SEEN}, {_RATED} SELECT item_id, url, source_type, score, row_number() OVER w::INT AS position, row_number() OVER w = 1 AS is_canonical FROM rated WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, discovered_at, url)".replace("row_number() OVER w::INT", "CAST(row_number() OVER w AS INT)"))
def _(v: Views) -> DataFrame:
    return resolve.canonical_sources(rated_sources(v)).select("item_id", "url", "source_type", "score", "position", "is_canonical")


@query("e10_source_order", f"WITH {_SEEN}, {_RATED} SELECT item_id, first(url ORDER BY score DESC, discovered_at, url) AS canonical_url, max(score) AS score, count(*) AS sources FROM rated GROUP BY item_id")
def _(v: Views) -> DataFrame:
    ranked = resolve.canonical_sources(rated_sources(v))
    return ranked.groupBy("item_id").agg(F.max(F.when(F.col("is_canonical"), F.col("url"))).alias("canonical_url"), F.max("score").alias("score"), F.count("*").alias("sources"))


@query("g17_source_type", f"WITH {_SEEN}, {_RATED} SELECT url, source_type, score FROM rated")
def _(v: Views) -> DataFrame:
    return rated_sources(v).select("url", "source_type", "score")


_OLD = "old AS (SELECT concat('ci_', k % 300) AS item_id, concat('u', k % 7) AS url, min(CASE WHEN k % 3 <> 0 THEN concat('h', k) END) AS hash, bool_or(k % 5 = 0) AS is_official, max(created_at) AS last_seen FROM content_items WHERE k % 2 = 0 GROUP BY 1, 2)"
_NEW = _OLD.replace("old AS", "new AS").replace("k % 2 = 0", "k % 2 = 1 OR k % 3 = 0").replace("concat('h', k)", "concat('n', k)")


def _source_side(v: Views, where: str, mark: str) -> DataFrame:
    rows = v.content_items.where(where)
    return rows.groupBy(F.expr("concat('ci_', k % 300)").alias("item_id"), F.expr("concat('u', k % 7)").alias("url")).agg(F.expr(f"min(case when k % 3 <> 0 then concat('{mark}', k) end)").alias("hash"), F.expr("bool_or(k % 5 = 0)").alias("is_official"), F.max("created_at").alias("last_seen"))


@query("r6_attach_sources", f"WITH {_OLD}, {_NEW} SELECT coalesce(o.item_id, n.item_id) AS item_id, coalesce(o.url, n.url) AS url, coalesce(n.hash, o.hash) AS hash, coalesce(o.is_official, false) OR coalesce(n.is_official, false) AS is_official, greatest(o.last_seen, n.last_seen) AS last_seen FROM old o FULL JOIN new n ON n.item_id = o.item_id AND n.url = o.url")
def _(v: Views) -> DataFrame:
    return resolve.attach_sources(_source_side(v, "k % 2 = 0", "h"), _source_side(v, "k % 2 = 1 or k % 3 = 0", "n"))


@query("a9_upsert", "WITH old AS (SELECT lower(trim(query)) AS q, count(*) AS hits, max(ts) AS last_seen FROM search_events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), new AS (SELECT lower(trim(query)) AS q, count(*) AS hits, max(ts) AS last_seen FROM search_events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1) SELECT coalesce(o.q, n.q) AS query, coalesce(o.hits, 0) + coalesce(n.hits, 0) AS hits, coalesce(n.last_seen, o.last_seen) AS last_seen FROM old o FULL JOIN new n ON n.q = o.q")
def _(v: Views) -> DataFrame:
    events = v.search_events.withColumn("query", F.lower(F.trim("query")))
    count = lambda rows: rows.groupBy("query").agg(F.count("*").alias("hits"), F.max("ts").alias("last_seen"))
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    return resolve.upsert(count(events.where(early)), count(events.where(~early)), ["query"], {"hits": F.coalesce("old_hits", F.lit(0)) + F.coalesce("new_hits", F.lit(0))})


_MERGES = "merges AS (SELECT id AS duplicate_id, concat('ci_', k - 1) AS canonical_id, k FROM content_items WHERE k % 20 = 7)"


def merged(v: Views) -> dict[str, DataFrame]:
    items = v.content_items.withColumns({"notification_number": F.lit(None).cast("string"), "document_checksum": F.expr("case when k % 3 = 0 then concat('s', k) end")})
    merges = v.content_items.where("k % 20 = 7").selectExpr("id as duplicate_id", "concat('ci_', k - 1) as canonical_id")
    sources = v.content_items.selectExpr("id as item_id", "source_url as url")
    return resolve.merge(items, sources, merges, AS_OF)


@query("r8_merge", f"""WITH {_MERGES}, items AS (SELECT *, CASE WHEN k % 3 = 0 THEN concat('s', k) END AS document_checksum FROM content_items)
SELECT i.id, CASE WHEN d.duplicate_id IS NOT NULL THEN 'archived' ELSE i.status END AS status, CASE WHEN d.duplicate_id IS NOT NULL THEN 'merged' WHEN c.canonical_id IS NOT NULL THEN 'canonical' ELSE i.duplicate_status END AS duplicate_status,
  coalesce(i.advertisement_number, g.advertisement_number) AS advertisement_number, coalesce(i.document_checksum, g.document_checksum) AS document_checksum, coalesce(d.canonical_id, c.canonical_id) AS duplicate_group_id
FROM items i LEFT JOIN merges d ON d.duplicate_id = i.id LEFT JOIN merges c ON c.canonical_id = i.id LEFT JOIN items g ON g.id = c.duplicate_id""")
def _(v: Views) -> DataFrame:
    return merged(v)["items"].select("id", "status", "duplicate_status", "advertisement_number", "document_checksum", "duplicate_group_id")


@query("r8_merge_sources", f"WITH {_MERGES} SELECT DISTINCT coalesce(m.canonical_id, i.id) AS item_id, i.source_url AS url FROM content_items i LEFT JOIN merges m ON m.duplicate_id = i.id")
def _(v: Views) -> DataFrame:
    return merged(v)["sources"]


#: Chains of up to four merges, cycles of three with chains that lead into them, a duplicate with two canonicals, an item that isn't there, and one merged with itself.
_CHAINS = """chained AS (
  SELECT id AS duplicate_id, concat('ci_', k - 1) AS canonical_id FROM content_items WHERE k % 60 % 6 BETWEEN 1 AND 4
  UNION ALL SELECT id, concat('ci_', CASE WHEN k % 60 = 17 THEN k - 12 ELSE k + 6 END) FROM content_items WHERE k % 60 IN (5, 11, 17)
  UNION ALL SELECT id, concat('ci_', k - 6) FROM content_items WHERE k % 60 IN (23, 29)
  UNION ALL SELECT id, concat('ci_', k - 7) FROM content_items WHERE k % 60 = 8
  UNION ALL SELECT id, 'ci_none' FROM content_items WHERE k % 60 = 35
  UNION ALL SELECT id, id FROM content_items WHERE k % 60 = 41)"""
_ROOTS = f"""{_CHAINS},
there AS (SELECT DISTINCT m.* FROM chained m JOIN content_items a ON a.id = m.duplicate_id JOIN content_items b ON b.id = m.canonical_id WHERE m.canonical_id <> m.duplicate_id),
single AS (SELECT duplicate_id, min(canonical_id) AS canonical_id FROM there GROUP BY 1),
trail AS (SELECT duplicate_id AS start, canonical_id AS node, 1 AS far FROM single UNION ALL SELECT start, canonical_id, far + 1 FROM trail JOIN single ON duplicate_id = node WHERE far < 12),
cyclic AS (SELECT DISTINCT start AS duplicate_id FROM trail WHERE start = node),
applied AS (SELECT * FROM single WHERE duplicate_id NOT IN (SELECT duplicate_id FROM cyclic)),
climb AS (SELECT duplicate_id, canonical_id AS node, 1 AS far FROM applied UNION ALL SELECT c.duplicate_id, a.canonical_id, far + 1 FROM climb c JOIN applied a ON a.duplicate_id = c.node),
roots AS (SELECT duplicate_id, arg_max(node, far) AS root_id, max(far) AS distance FROM climb GROUP BY 1)"""


def chain_merged(v: Views) -> dict[str, DataFrame]:
    items = v.content_items.withColumns({"notification_number": F.lit(None).cast("string"), "document_checksum": F.expr("case when k % 3 = 0 then concat('s', k) end")})
    merges = v.sql(f"WITH {_CHAINS} SELECT * FROM chained")
    return resolve.merge(items, v.content_items.selectExpr("id as item_id", "source_url as url"), merges, AS_OF)


@query("r8_merge_chains", f"""WITH RECURSIVE {_ROOTS}, items AS (SELECT *, CASE WHEN k % 3 = 0 THEN concat('s', k) END AS document_checksum FROM content_items),
ways AS (SELECT duplicate_id, canonical_id AS canon, 1 AS far FROM applied UNION ALL SELECT duplicate_id, root_id, distance FROM roots WHERE distance > 1),
given AS (SELECT canon, arg_min(advertisement_number, (far, id)) FILTER (advertisement_number IS NOT NULL) AS advt, arg_min(document_checksum, (far, id)) FILTER (document_checksum IS NOT NULL) AS checksum FROM ways JOIN items ON id = duplicate_id GROUP BY canon)
SELECT i.id, CASE WHEN r.root_id IS NOT NULL THEN 'archived' ELSE i.status END AS status, CASE WHEN r.root_id IS NOT NULL THEN 'merged' WHEN g.canon IS NOT NULL THEN 'canonical' ELSE i.duplicate_status END AS duplicate_status,
  coalesce(i.advertisement_number, g.advt) AS advertisement_number, coalesce(i.document_checksum, g.checksum) AS document_checksum, coalesce(r.root_id, g.canon) AS duplicate_group_id
FROM items i LEFT JOIN roots r ON r.duplicate_id = i.id LEFT JOIN given g ON g.canon = i.id""")
def _(v: Views) -> DataFrame:
    return chain_merged(v)["items"].select("id", "status", "duplicate_status", "advertisement_number", "document_checksum", "duplicate_group_id")


@query("r8_chain_sources", f"WITH RECURSIVE {_ROOTS} SELECT DISTINCT coalesce(r.root_id, i.id) AS item_id, i.source_url AS url FROM content_items i LEFT JOIN roots r ON r.duplicate_id = i.id")
def _(v: Views) -> DataFrame:
    return chain_merged(v)["sources"]


@query("r8_rejected_merges", f"""WITH RECURSIVE {_ROOTS} SELECT DISTINCT m.canonical_id, m.duplicate_id, CASE WHEN m.canonical_id = m.duplicate_id THEN 'self' WHEN t.duplicate_id IS NULL THEN 'missing' WHEN s.duplicate_id IS NULL THEN 'repeated' ELSE 'cycle' END AS reason
FROM chained m LEFT JOIN there t ON t.duplicate_id = m.duplicate_id AND t.canonical_id = m.canonical_id LEFT JOIN single s ON s.duplicate_id = m.duplicate_id AND s.canonical_id = m.canonical_id LEFT JOIN cyclic c ON c.duplicate_id = m.duplicate_id
WHERE s.duplicate_id IS NULL OR c.duplicate_id IS NOT NULL""")
def _(v: Views) -> DataFrame:
    return chain_merged(v)["rejected"]


_ROUTE = "CASE type WHEN 'job' THEN 'jobs' WHEN 'result' THEN 'results' WHEN 'admit_card' THEN 'admit-card' WHEN 'answer_key' THEN 'answer-key' WHEN 'exam' THEN 'exams' WHEN 'scholarship' THEN 'scholarships' WHEN 'scheme' THEN 'schemes' ELSE 'important-updates' END"


@query("r8_chain_redirects", f"WITH RECURSIVE {_ROOTS}, paths AS (SELECT id, concat('/', {_ROUTE}, '/', slug) AS path FROM content_items) SELECT a.path AS from_path, b.path AS to_path FROM roots JOIN paths a ON a.id = duplicate_id JOIN paths b ON b.id = root_id WHERE a.path <> b.path")
def _(v: Views) -> DataFrame:
    return chain_merged(v)["redirects"].select("from_path", "to_path")


@query("r8_merge_redirects", f"WITH {_MERGES}, paths AS (SELECT id, concat('/', {_ROUTE}, '/', slug) AS path FROM content_items) SELECT a.path AS from_path, b.path AS to_path FROM merges JOIN paths a ON a.id = duplicate_id JOIN paths b ON b.id = canonical_id WHERE a.path <> b.path")
def _(v: Views) -> DataFrame:
    return merged(v)["redirects"].select("from_path", "to_path")


@query("g4_clean_content", r"""SELECT page_id, sha256(CASE WHEN length(c) > 0 THEN c ELSE trim(html) END) AS fingerprint, length(c) AS n FROM (SELECT page_id, html, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript|svg|iframe)\b.*?</(script|style|noscript|svg|iframe)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''),
  '(?i)\b(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),\s+\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{4}\s+\d{2}:\d{2}:\d{2}\s+(?:GMT|IST|UTC)\b', ' ', 'g'), '(?i)\b\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM|IST)?\b', ' ', 'g'), '(?i)Visitor\s*Count\s*:\s*\d+', ' ', 'g'), '(?i)Page\s*Hits\s*:\s*\d+', ' ', 'g'), '[\s ]+', ' ', 'g'))) AS c FROM {pages})""")
def _(v: Views) -> DataFrame:
    pages = v.raw("pages").select("page_id", exprs.content(F.col("html")).alias("c"))
    return pages.select("page_id", F.col("c.fingerprint").alias("fingerprint"), F.col("c.length").alias("n"))


@query("g14_job_status", f"SELECT id, {STATUS} AS status FROM (SELECT i.id, i.type, j.application_start, j.application_last_date FROM content_items i LEFT JOIN jobs j ON j.content_item_id = i.id)")
def _(v: Views) -> DataFrame:
    rows = v.content_items.select("id", "type").join(v.jobs.select("content_item_id", "application_start", "application_last_date"), F.col("id") == F.col("content_item_id"), "left")
    return rows.select("id", exprs.job_status(F.col("type"), F.col("application_start"), F.col("application_last_date"), F.lit(AS_OF).cast("timestamp")).alias("status"))


@query("g15_slugs_routes", f"SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(concat(title, ' & More!'))), '\\s+', '-', 'g'), '&', '-and-', 'g'), '[^A-Za-z0-9_\\-]+', '', 'g'), '-{{2,}}', '-', 'g') AS slug, {_ROUTE} AS route, concat('/', {_ROUTE}, '/', slug) AS url FROM content_items".replace("{{2,}}", "{2,}"))
def _(v: Views) -> DataFrame:
    return v.content_items.select("id", exprs.slug(F.concat("title", F.lit(" & More!"))).alias("slug"), exprs.route(F.col("type")).alias("route"), exprs.target_url(F.col("type"), F.col("slug")).alias("url"))


@query("g12_vacancies", "SELECT content_item_id, vacancy, CASE WHEN try_cast(regexp_replace(vacancy, '[^0-9]', '', 'g') AS BIGINT) > 0 THEN try_cast(regexp_replace(vacancy, '[^0-9]', '', 'g') AS BIGINT) END::VARCHAR AS number, CASE WHEN vacancy IS NULL THEN NULL ELSE coalesce(try_cast(nullif(regexp_extract(vacancy, '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT), 0) END::VARCHAR AS prefix FROM jobs")
def _(v: Views) -> DataFrame:
    return v.jobs.select("content_item_id", "vacancy", exprs.vacancy_number(F.col("vacancy")).cast("string").alias("number"), exprs.integer_prefix(F.col("vacancy")).cast("string").alias("prefix"))


@query("g11_identity_strings", f"SELECT id, concat_ws('|', nullif({sql_norm('organization_id')}, ''), nullif({sql_norm('title')}, ''), nullif({sql_norm('advertisement_number')}, '')) AS identity FROM content_items")
def _(v: Views) -> DataFrame:
    return v.content_items.select("id", exprs.identity_string(F.col("organization_id"), F.col("title"), F.col("advertisement_number")).alias("identity"))


@query("r3_candidates", f"WITH {NOTICES}, {IDENT}, {_pairs('ids', 'ids', 'a.id < b.id AND (a.advt = b.advt OR a.pdf = b.pdf OR a.org = b.org) AND (a.rec IS NULL OR b.rec IS NULL OR a.rec = b.rec)')} SELECT a_id, b_id FROM pairs")
def _(v: Views) -> DataFrame:
    ids = resolve.identities(notices(v), AS_OF)
    of_one, others = resolve.pairs_of(ids)
    return of_one.select("a_id", "b_id").unionByName(others.select("a_id", "b_id"))


@query("r2_pair_scores", f"WITH {NOTICES}, {IDENT}, {_pairs('ids', 'ids', 'a.id < b.id AND (a.advt = b.advt OR a.pdf = b.pdf OR a.org = b.org) AND (a.rec IS NULL OR b.rec IS NULL OR a.rec = b.rec)')}, {SCORE} SELECT a_id, b_id, confidence, tier, status FROM scored")
def _(v: Views) -> DataFrame:
    ids = resolve.identities(notices(v), AS_OF)
    return resolve.scored_pairs(ids).select("a_id", "b_id", "confidence", "tier", "status")


#: The score with all three guards, for pairs of any type and year.
_GUARDED = SCORE.replace("CASE WHEN a_rec <> b_rec THEN 'recruitment_name' END AS guard", "CASE WHEN a_content_type <> b_content_type THEN 'content_type' WHEN a_year <> b_year THEN 'year' WHEN a_rec <> b_rec THEN 'recruitment_name' END AS guard").replace("+ 15 +", "+ CASE WHEN a_year = b_year THEN 15 ELSE 0 END +")


#: Numbers and checksums of incoming notices, over all pairs.
_MATCHED = _GUARDED.replace("CASE WHEN a_advt = b_advt THEN 98", "CASE WHEN a_checksum = b_checksum THEN 100 WHEN a_advt = b_advt OR a_notif = b_notif THEN 98")
_NUMBERED = "numbered AS (SELECT *, CASE WHEN k % 4 = 0 THEN concat('ntf', k % 97) END AS notif, CASE WHEN k % 9 = 0 THEN concat('s', k % 53) END AS checksum FROM ids), incoming AS (SELECT * FROM numbered WHERE created_at >= TIMESTAMP '2024-01-25'), catalogue AS (SELECT * FROM numbered WHERE created_at < TIMESTAMP '2024-01-25')"
_ALL_PAIRS = _pairs("incoming", "catalogue", "TRUE", ("notif", "checksum")).replace("a.content_type = b.content_type AND a.year = b.year AND TRUE", "TRUE")


@query("r5_match_incoming", f"""WITH {NOTICES}, {IDENT}, {_NUMBERED}, {_ALL_PAIRS}, {_MATCHED},
found AS (SELECT *, CASE WHEN a_advt = b_advt OR a_notif = b_notif THEN 1 WHEN a_checksum = b_checksum THEN 2 ELSE 3 END AS stage FROM scored),
best AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY stage, confidence DESC, b_created_at DESC, b_id) AS rank FROM found WHERE confidence >= 50 OR stage < 3)
SELECT a_id AS incoming_id, b_id AS match_id, confidence, tier, status, CASE WHEN guard = 'content_type' THEN 'link_related_stage' WHEN status = 'canonical' THEN 'link_to_canonical' WHEN status = 'review_required' THEN 'review_required' ELSE 'create_unique' END AS action, stage FROM best WHERE rank = 1""")
def _(v: Views) -> DataFrame:
    """The notices of the last week against all earlier ones."""
    rows = notices(v).withColumns({"notification_number": F.expr("case when k % 4 = 0 then concat('ntf', k % 97) end"), "document_checksum": F.expr("case when k % 9 = 0 then concat('s', k % 53) end")})
    late = F.col("created_at") >= F.lit("2024-01-25").cast("timestamp")
    return resolve.match_incoming(rows.where(late), rows.where(~late), AS_OF)


@query("r2_guarded_scores", f"WITH {NOTICES}, {IDENT}, {_pairs('ids', 'ids', 'TRUE').replace('a.content_type = b.content_type AND a.year = b.year AND TRUE', 'b.k = a.k + 1')}, {_GUARDED} SELECT a_id, b_id, confidence, tier, status, array_to_string(conflicts, ',') AS conflicts, CASE WHEN guard = 'content_type' THEN 'link_related_stage' WHEN status = 'canonical' THEN 'link_to_canonical' WHEN status = 'review_required' THEN 'review_required' ELSE 'create_unique' END AS action FROM scored")
def _(v: Views) -> DataFrame:
    """Neighbours by number: most differ in type, year or recruitment."""
    ids = written(resolve.identities(notices(v), AS_OF), "identities").withColumn("k", F.substring("id", 4, 18).cast("long"))
    a, b = (ids.select(*[F.col(c).alias(f"{side}_{c}") for c in resolve.IDENTITY], (F.col("k") - shift).alias("k")) for side, shift in (("a", 0), ("b", 1)))
    return resolve.scored(a.join(b, "k")).select("a_id", "b_id", "confidence", "tier", "status", F.array_join("conflicts", ",").alias("conflicts"), "action")


@query("g7_organization_names", f"SELECT id, {sql_organization('title')} AS organization FROM content_items")
def _(v: Views) -> DataFrame:
    return v.content_items.select("id", exprs.organization_name(exprs.normalize_text(F.col("title"))).alias("organization"))


@query("g8_recruitment_names", f"SELECT id, {sql_recruitment('title')} AS recruitment FROM content_items")
def _(v: Views) -> DataFrame:
    return v.content_items.select("id", exprs.recruitment_name(exprs.normalize_text(F.col("title"))).alias("recruitment"))


@query("g9_title_detection", f"SELECT id, {sql_in_title('title', exprs.TITLE_ORGANIZATIONS)} AS organization, {sql_in_title('title', exprs.TITLE_EXAMS)} AS exam, CASE WHEN k % 3 = 0 THEN concat('CEN-', k) ELSE NULL END AS number FROM content_items")
def _(v: Views) -> DataFrame:
    norm = exprs.normalize_text(F.col("title"))
    numbered = F.expr("case when k % 3 = 0 then concat(title, ' Advt No: CEN-', k) else title end")
    return v.content_items.select("id", exprs.organization_in_title(norm).alias("organization"), exprs.exam_in_title(norm).alias("exam"), exprs.number_in_title(numbered).alias("number"))


@query("g10_years_and_numbers", f"SELECT id, try_cast(nullif(regexp_extract(title, '\\b(202[0-9]|203[0-9])\\b', 1), '') AS INT) AS year, {sql_number('n')} AS number FROM (SELECT id, title, concat('Advt. No. ', advertisement_number) AS n FROM content_items WHERE advertisement_number IS NOT NULL)")
def _(v: Views) -> DataFrame:
    rows = v.content_items.where("advertisement_number is not null")
    return rows.select("id", exprs.year_in(F.col("title")).alias("year"), exprs.notice_number(F.concat(F.lit("Advt. No. "), "advertisement_number")).alias("number"))
