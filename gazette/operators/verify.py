"""Verification, quality, publishing and linking of notices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.functions import exprs, templates
from gazette.operators.search import occurrences
from gazette.session import written

# ---- Fixed values ----
CLASS_WORDS = {
    "government_job": ("recruitment", "vacancy", "apply online", "notification"),
    "result": ("result", "merit list", "marksheet", "score card"),
    "admit_card": ("admit card", "hall ticket", "call letter"),
    "answer_key": ("answer key", "question paper", "objection"),
}
CLASS_TYPES = {"government_job": "job", "result": "result", "admit_card": "admit_card", "answer_key": "answer_key", "exam": "exam", "scholarship": "scholarship", "syllabus": "syllabus", "scheme": "scheme"}
SUSPICIOUS_HOSTS = ("bit.ly", "tinyurl.com", "t.me", "goo.gl", "is.gd", "buff.ly", "adf.ly", "cutt.ly", "ow.ly", "free-job-alerts.xyz", "sarkari-fake.net")
TRUSTED_ENDS = (".gov.in", ".nic.in", ".res.in", ".ac.in", ".edu.in", ".org.in", ".mil.in", ".gov", ".nic")
LINK_FIELDS = ("official_notification_url", "official_apply_url", "official_website_url", "result_url", "merit_list_url", "cutoff_url", "download_url", "answer_key_url")
COMPLETE_FIELDS = ("organization", "post_name", "exam_name", "title", "vacancy", "application_last_date", "result_date", "admit_card_date", "answer_key_date", "official_notification_url", "official_apply_url", "result_url", "download_url")
CHECKED_FIELDS = {"advertisement_number": "WARNING", "application_last_date": "CRITICAL", "application_start": "WARNING", "result_date": "CRITICAL", "admit_card_date": "CRITICAL", "answer_key_date": "CRITICAL"}
WATCHED_FIELDS = ("application_last_date", "application_start", "exam_date", "vacancy", "qualification", "salary", "application_fee", "official_apply_url", "official_notification_url", "result_date", "admit_card_date", "answer_key_date")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
NOT_JOBS = ("/results", "/admit-card", "/answer-key", "/syllabus", "/schemes", "/exams", "/scholarships", "/important-updates")
LIFECYCLE = ("result", "admit_card", "answer_key")
LEVELS = ("10th", "12th", "graduate", "b.tech")
# ---- End of fixed values ----


EXTRACTED = "title string, organization string, post_name string, vacancy string, qualification string, application_start string, application_last_date string, advertisement_number string, official_apply_url string, confidence string, evidence array<struct<field:string,value:string,evidence:string>>"


def parsed_responses(responses: DataFrame, schema: str = EXTRACTED) -> tuple[DataFrame, DataFrame]:
    """H2: responses(id, response) as (typed rows, with ways of saying nothing made null and the confidence within 0..1; rows (id, response) that can't be parsed)."""
    rows = responses.withColumn("_json", templates.repaired_json(F.col("response"))).withColumn("_ok", F.try_parse_json("_json").isNotNull() & F.ltrim("_json").startswith("{"))
    typed = rows.where("_ok").withColumn("x", F.from_json("_json", schema)).select("id", "x.*")
    cleaned = {c: exprs.without_no_value(F.col(c)) for c, t in typed.dtypes if t == "string" and c not in ("id", "confidence")}
    out = typed.withColumns(cleaned)
    if "confidence" in typed.columns:
        out = out.withColumn("confidence", exprs.clamped(F.coalesce(exprs.number_of(F.col("confidence")), F.lit(0.85))))
    return out, rows.where(~F.col("_ok")).select("id", "response")


def classify(texts: DataFrame, text: str = "text") -> DataFrame:
    """H1: class and content type by the first group of words that occurs in the first 8000 characters."""
    low = F.substring(F.lower(F.coalesce(F.col(text), F.lit(""))), 1, 8000)
    kind = exprs.let(low, lambda t: exprs.cases([(reduce(Column.__or__, [t.contains(w) for w in words]), c) for c, words in CLASS_WORDS.items()], "other"))
    return texts.withColumn("class", kind).withColumn("content_type", exprs.lookup(F.col("class"), CLASS_TYPES, "update"))


def link_status(url: Column, source_url: Column | None = None) -> Column:
    """H6: unverified (none), broken, suspicious, valid or unverified."""
    host = F.lower(F.try_parse_url(F.trim(url), F.lit("HOST")))
    scheme = F.lower(F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    bad = reduce(Column.__or__, [(host == d) | host.endswith("." + d) for d in SUSPICIOUS_HOSTS])
    good = reduce(Column.__or__, [host.endswith(t) for t in TRUSTED_ENDS])
    if source_url is not None:
        s = F.lower(F.try_parse_url(source_url, F.lit("HOST")))
        good = good | F.coalesce((host == s) | host.endswith(F.concat(F.lit("."), s)) | s.endswith(F.concat(F.lit("."), host)), F.lit(False))
    empty = url.isNull() | (F.trim(url) == "")
    return F.when(empty, "unverified").when(scheme == "", "broken").when(~scheme.isin("http", "https"), "suspicious").when(host.isNull(), "broken").when(bad, "suspicious").when(good, "valid").otherwise("unverified")


def links(extracted: DataFrame, key: str = "id", source_url: str | None = None) -> DataFrame:
    """H6: (key, field, url, link_status) of every link field that has a value."""
    have = [f for f in LINK_FIELDS if f in extracted.columns]
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("url")) for f in have])
    each = extracted.select(key, *([source_url] if source_url else []), F.explode(F.filter(pairs, lambda p: F.coalesce(p["url"], F.lit("")) != "")).alias("l")).select(key, *([source_url] if source_url else []), "l.*")
    return each.withColumn("link_status", link_status(F.col("url"), F.col(source_url) if source_url else None)).select(key, "field", "url", "link_status")


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[,\s\-_/]", "")


def found_in(value: Column, source: Column, mode: str = "strict") -> Column:
    """Whether a value stands in a source, both as _plain gives them; a date also with its month's name, day or month first. mode 'reference': day and year anywhere."""
    plain = _plain(value)
    date = value.rlike(r"^\d{4}-\d{2}-\d{2}$")
    y, m, d = F.substring(value, 1, 4), F.substring(value, 6, 2), F.substring(value, 9, 2)
    name = F.element_at(F.array(*[F.lit(x) for x in MONTHS]), F.greatest(F.lit(1), F.least(F.lit(12), m.try_cast("int"))))
    orders = source.contains(F.concat(d, m, y)) | source.contains(F.concat(d, name, y)) | source.contains(F.concat(name, d, y))
    if mode == "reference":
        orders = orders | (source.contains(d) & source.contains(y))
    return value.isNull() | (value == "") | (plain == "") | source.contains(plain) | (date & orders)


def conflicts(extracted: DataFrame, key: str = "id", text: str = "source_text", mode: str = "strict") -> DataFrame:
    """H3, H5: key, conflicts (field, severity), verified, critical and confidence. Link conflicts come from links()."""
    have = set(extracted.columns)
    rows = extracted.withColumn("_source", _plain(F.coalesce(F.col(text), F.lit(""))))
    numbers = F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\b\d+(?:,\d+)*\b"), 0), lambda x: F.regexp_replace(x, ",", ""))
    found = []
    if "vacancy" in have:
        first = F.regexp_replace(F.regexp_extract(F.col("vacancy"), r"\b\d+(?:,\d+)*\b", 0), ",", "")
        found.append(F.when((first != "") & ~F.array_contains(numbers, first), F.struct(F.lit("vacancy").alias("field"), F.lit("CRITICAL").alias("severity"))))
    for field, severity in CHECKED_FIELDS.items():
        if field in have:
            found.append(F.when(~found_in(F.col(field), F.col("_source"), mode), F.struct(F.lit(field).alias("field"), F.lit(severity).alias("severity"))))
    out = rows.withColumn("conflicts", F.array_compact(F.array(*found)))
    critical = F.exists("conflicts", lambda c: c["severity"] == "CRITICAL")
    confidence = F.when(critical, 0.4).when(F.size("conflicts") > 0, 0.75).otherwise(0.98)
    return out.select(key, "conflicts", (F.size("conflicts") == 0).alias("verified"), critical.alias("critical"), confidence.alias("confidence"))


def evidence_found(evidence: DataFrame, text: str = "source_text") -> DataFrame:
    """H4: evidence(value, evidence, source_text) with authentic: short, or its head, tail, one of its words or the value in the source."""
    source, plain = _plain(F.coalesce(F.col(text), F.lit(""))), _plain(F.col("evidence"))
    word = F.exists(F.split(plain, " "), lambda w: (F.length(w) > 4) & source.contains(w))
    ok = (F.length("evidence") <= 5) | source.contains(F.left(plain, F.lit(20))) | source.contains(F.right(plain, F.lit(20))) | word | found_in(F.col("value"), source)
    return evidence.withColumn("authentic", F.coalesce(ok, F.lit(True)))


def quality(rows: DataFrame, publish_at: int = 90, review_at: int = 75) -> DataFrame:
    """H7: rows with trust_level, evidence_count, broken, suspicious, critical_count, warning_count and the extracted fields; scores, total and eligibility."""
    have = [f for f in COMPLETE_FIELDS if f in rows.columns]
    full = F.size(F.filter(F.array(*[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in have]), lambda x: x != ""))
    n = F.col("evidence_count")
    scores = {
        "trust_score": F.when(F.col("trust_level").isNull(), 20).otherwise(F.least(F.greatest(F.col("trust_level"), F.lit(1)), F.lit(5)) * 6),
        "fields_score": F.least(full * 4, F.lit(20)),
        "evidence_score": F.when(n >= 3, 20).when(n == 2, 15).when(n == 1, 10).otherwise(0),
        "links_score": F.greatest(F.lit(0), 15 - 10 * F.col("broken") - 10 * F.col("suspicious")),
        "conflicts_score": F.when(F.col("critical_count") > 0, 0).otherwise(F.greatest(F.lit(0), 15 - 5 * F.col("warning_count"))),
    }
    out = rows.withColumns(scores)
    total = F.least(F.greatest(reduce(Column.__add__, [F.col(c) for c in scores]), F.lit(0)), F.lit(100))
    out = out.withColumn("total_score", total)
    return out.withColumn("eligibility", F.when(F.col("critical_count") > 0, "review_required").when(F.col("total_score") >= publish_at, "auto_publish_eligible").when(F.col("total_score") >= review_at, "review_required").otherwise("rejected"))


def publish_decision(rows: DataFrame, gate: str = "conflict") -> DataFrame:
    """H8: status published or review; by critical conflicts alone, or by eligibility too."""
    ok = F.col("critical_count") == 0
    if gate == "quality":
        ok = ok & (F.col("eligibility") == "auto_publish_eligible")
    return rows.withColumn("decision", F.when(ok, "published").otherwise("review"))


def field_changes(old: DataFrame, new: DataFrame, key: str = "id", fields: tuple[str, ...] = WATCHED_FIELDS) -> DataFrame:
    """H9: key, changes (field, was, now) and a summary, of rows with a changed field."""
    have = [f for f in fields if f in old.columns and f in new.columns]
    o, n = old.select(key, *[F.col(f).cast("string").alias(f"_o_{f}") for f in have]), new.select(key, *[F.col(f).cast("string").alias(f"_n_{f}") for f in have])
    differ = F.array_compact(F.array(*[F.when(~F.col(f"_o_{f}").eqNullSafe(F.col(f"_n_{f}")), F.struct(F.lit(f).alias("field"), F.col(f"_o_{f}").alias("was"), F.col(f"_n_{f}").alias("now"))) for f in have]))
    rows = o.join(n, key).select(key, differ.alias("changes")).where(F.size("changes") > 0)
    line = F.transform("changes", lambda c: F.format_string('- Field "%s" changed from "%s" to "%s".', c["field"], F.coalesce(c["was"], F.lit("N/A")), F.coalesce(c["now"], F.lit("N/A"))))
    return rows.withColumn("summary", F.concat(F.lit("**Important Update:**\n"), F.array_join(line, "\n")))


def next_versions(existing: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """New rows numbered on from each item's highest version."""
    last = existing.groupBy("content_item_id").agg(F.max("version").alias("_last"))
    nth = F.row_number().over(Window.partitionBy("content_item_id").orderBy(*order))
    return new.withColumn("_nth", nth).join(last, "content_item_id", "left").withColumn("version", F.coalesce("_last", F.lit(0)) + F.col("_nth")).drop("_nth", "_last")


def relationship(a: str = "a_", b: str = "b_", as_of: str = "") -> Column:
    """Points of relation of item b to item a."""
    x, y = (lambda c: F.col(a + c)), (lambda c: F.col(b + c))
    same = lambda c: F.coalesce(x(c) == y(c), F.lit(False))
    px, py = (F.nullif(F.lower(F.trim(side("post_name"))), F.lit("")) for side in (x, y))
    post = F.coalesce(px.contains(py) | py.contains(px), F.lit(False))
    level = F.coalesce(reduce(Column.__or__, [F.lower(x("qualification")).contains(q) & F.lower(y("qualification")).contains(q) for q in LEVELS]), F.lit(False))
    cycle = ((x("type") == "job") & y("type").isin(*LIFECYCLE)) | ((y("type") == "job") & x("type").isin(*LIFECYCLE))
    at = F.lit(as_of).cast("timestamp")
    recent = F.coalesce((y("published_at") <= at) & (y("published_at") >= at - F.expr("interval 14 days")), F.lit(False))
    points = ((same("organization_id"), 40), (post, 35), (same("category_id"), 25), (level, 15), (cycle, 15), (recent, 5))
    return reduce(Column.__add__, [F.when(c, n).otherwise(0) for c, n in points])


def link_facts(public: DataFrame, as_of: str) -> DataFrame:
    """Id, published_at and the facets that points of relation depend on: organization, category, post name, a bit per level, stage (1 job, 2 later stage) and recency."""
    level = reduce(Column.__add__, [F.when(F.lower("qualification").contains(q), 1 << i).otherwise(0) for i, q in enumerate(LEVELS)])
    stage = F.when(F.col("type") == "job", 1).when(F.col("type").isin(*LIFECYCLE), 2).otherwise(0)
    at = F.lit(as_of).cast("timestamp")
    recent = F.coalesce((F.col("published_at") <= at) & (F.col("published_at") >= at - F.expr("interval 14 days")), F.lit(False))
    return public.select("id", "published_at", F.col("organization_id").alias("org"), F.col("category_id").alias("cat"), F.nullif(F.lower(F.trim("post_name")), F.lit("")).alias("post"), level.alias("level"), stage.alias("stage"), recent.alias("recent"))


#: Names up to so many characters are looked up by all their parts, at most 2080 of 22 characters on average.
SHORT_NAME = 64


def containing_posts(facts: DataFrame) -> DataFrame:
    """(post, other) pairs of post names of which one contains the other, both ways; a blank name is none. Every part of a short name is looked up among the names; of long names, what contains a name is found by grams. Either way no pair of names is compared that shares nothing."""
    names = written(facts.where("post is not null").select("post").distinct(), "post-names")
    short = names.where(F.length("post") <= SHORT_NAME)
    part = F.expr("flatten(transform(sequence(1, length(post)), i -> transform(sequence(1, length(post) - i + 1), n -> substring(post, i, n))))")
    parts = short.select("post", F.explode(F.array_distinct(part)).alias("other"))
    inner = parts.join(names.select(F.col("post").alias("other")), "other").select("post", "other")
    long = names.where(F.length("post") > SHORT_NAME)
    if not long.isEmpty():
        held = occurrences(long.select(F.col("post").alias("id"), F.col("post").alias("text")), names.select(F.col("post").alias("term_id"), F.col("post").alias("term")))
        inner = inner.union(held.select(F.col("id").alias("post"), F.col("term_id").alias("other")))
    return inner.union(inner.select("other", "post")).distinct()


#: Points for an equal organization, a post name within the other's, an equal category.
KEY_POINTS = {"org": 40, "post": 35, "cat": 25}


def internal_links(public: DataFrame, as_of: str, least: int = 20, n: int = 6) -> DataFrame:
    """Up to n ranked links an item, among all others.

    Under each subset of the keys (organization, post, category) only the n + 1 best per key, level and stage are kept. That is exact:
    of an item's n best, take b with the set S of keys it shares. Whatever stands before b under the key of S, ranked by the points of
    S, level, stage and recency, has at least these points with the item, and stands before b in the item's own ranking too. So b is
    among the n + 1 best there (one may be the item itself), with its full points; under smaller sets it shows fewer, and the most count.
    Items with equal facets share one ranking of n + 1. So rows stay in proportion to items.
    """
    facts, keys, newest = written(link_facts(public, as_of), "link-facts"), list(KEY_POINTS), [F.desc_nulls_last("b_at"), F.asc("b_id")]
    subsets = F.explode(F.sequence(F.lit(0), F.lit(2 ** len(keys) - 1))).alias("keys")

    def keyed(rows: DataFrame, *more: str) -> DataFrame:
        """A row per subset of keys whose values aren't null; other keys are null."""
        has = {k: F.col("keys").bitwiseAND(1 << i) > 0 for i, k in enumerate(keys)}
        every = rows.select(subsets, *keys, *more).where(reduce(Column.__and__, [~h | F.col(k).isNotNull() for k, h in has.items()]))
        return every.select("keys", *[F.when(h, F.col(k)).alias(k) for k, h in has.items()], *more)

    def best(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
        return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n + 1).drop("_r")

    def same(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        right = right.withColumnsRenamed({c: f"_{c}" for c in on})
        return left.join(right, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on])).drop(*[f"_{c}" for c in on])

    b_facets = ["b_level", "b_stage", "b_recent"]
    b = facts.select(*keys, *[F.col(c).alias(f"b_{c}") for c in ("id", "level", "stage", "recent")], F.col("published_at").alias("b_at"))
    b = best(keyed(b, "b_id", "b_at", *b_facets), ["keys", *keys, *b_facets], newest)
    with_post = F.col("post").isNotNull()
    matched = b.where(with_post).withColumnRenamed("post", "other").join(containing_posts(facts), "other").select(*b.columns)
    b = b.where(~with_post).unionByName(best(matched, ["keys", *keys, *b_facets], newest))

    groups = facts.select(*keys, "level", "stage").distinct()
    group = [F.col(c).alias(f"g_{c}") for c in keys]
    asked = keyed(groups, "level", "stage").distinct()
    points = reduce(Column.__add__, [F.when(F.col("keys").bitwiseAND(1 << i) > 0, p).otherwise(0) for i, p in enumerate(KEY_POINTS.values())])
    level = F.when(F.col("level").bitwiseAND(F.col("b_level")) > 0, 15).otherwise(0)
    stage = F.when(F.col("stage") * F.col("b_stage") == 2, 15).otherwise(0)
    scored = same(asked, b, ["keys", *keys]).withColumn("score", points + level + stage + F.when(F.col("b_recent"), 5).otherwise(0)).where(F.col("score") >= least)
    order = [F.desc("score"), *newest]
    scored = best(scored, ["keys", *keys, "level", "stage"], order).select("keys", *keys, "level", "stage", "b_id", "b_at", "score")

    whole = [f"g_{c}" for c in keys]
    found = same(keyed(groups.select("*", *group), "level", "stage", *whole), scored, ["keys", *keys, "level", "stage"])
    once = found.groupBy(*whole, "level", "stage", "b_id").agg(F.max("score").alias("score"), F.max("b_at").alias("b_at"))
    lists = best(once, [*whole, "level", "stage"], order).withColumnsRenamed({f"g_{c}": c for c in keys})
    links = same(facts.select(F.col("id").alias("a_id"), *keys, "level", "stage"), lists, [*keys, "level", "stage"]).where("a_id <> b_id")
    rank = F.row_number().over(Window.partitionBy("a_id").orderBy(*order))
    return links.withColumn("rank", rank).where(F.col("rank") <= n).select("a_id", "b_id", "score", "rank")


def decided(items: DataFrame, decisions: DataFrame, at: str) -> DataFrame:
    """The last decision of each item applied: approve publishes (first published_at kept), draft and reject set the status."""
    last = decisions.groupBy("item_id").agg(F.max_by("action", F.struct("ts", "seq")).alias("_action"))
    status = F.when(F.col("_action") == "approve", "published").when(F.col("_action") == "draft", "draft").when(F.col("_action") == "reject", "archived").otherwise(F.col("status"))
    out = items.join(last, F.col("id") == F.col("item_id"), "left").withColumn("status", status)
    return out.withColumn("published_at", F.when(F.col("_action") == "approve", F.coalesce("published_at", F.lit(at).cast("timestamp"))).otherwise(F.col("published_at"))).drop("item_id", "_action")


def decided_users(users: DataFrame, decisions: DataFrame) -> DataFrame:
    """Users with the status of the last decision(user_id, action, ts, seq) on each: suspend or activate; other actions change nothing."""
    known = decisions.where(F.col("action").isin("suspend", "activate"))
    last = known.groupBy("user_id").agg(F.max_by("action", F.struct("ts", "seq")).alias("_action"))
    status = F.when(F.col("_action") == "suspend", "suspended").when(F.col("_action") == "activate", "active").otherwise(F.col("status"))
    return users.join(last, F.col("id") == F.col("user_id"), "left").withColumn("status", status).drop("user_id", "_action")


def resolved_errors(errors: DataFrame, decisions: DataFrame) -> DataFrame:
    """Errors with resolved set where a decision(error_id) names them; it is never taken back."""
    named = decisions.select("error_id").distinct()
    return errors.join(named, F.col("id") == F.col("error_id"), "left").withColumn("resolved", F.col("resolved") | F.col("error_id").isNotNull()).drop("error_id")


def published_in_bulk(items: DataFrame, at: str) -> DataFrame:
    """Drafts, and archived items that are eligible, become published."""
    go = (F.col("status") == "draft") | ((F.col("status") == "archived") & F.col("auto_publish_eligible"))
    return items.withColumn("published_at", F.when(go, F.coalesce("published_at", F.lit(at).cast("timestamp"))).otherwise(F.col("published_at"))).withColumn("status", F.when(go, "published").otherwise(F.col("status")))


def erased(tables: dict[str, DataFrame], gone: DataFrame, cascade: dict[str, str], set_null: dict[str, str]) -> dict[str, DataFrame]:
    """Tables without the rows of the ids in gone(id): cascade maps a table to the key by which its rows go, set_null to the key that becomes null."""
    ids = gone.select(F.col("id").alias("_gone")).distinct()
    out = dict(tables)
    for name, key in cascade.items():
        out[name] = tables[name].join(ids, F.col(key) == F.col("_gone"), "left_anti")
    for name, key in set_null.items():
        out[name] = tables[name].join(ids, F.col(key) == F.col("_gone"), "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone")
    return out


def index_directive(explicit: Column, status: Column, preview: Column, path: Column, params: Column, total: Column, least: Column) -> Column:
    """Robots directive by seven rules in order. params: map of query parameters."""
    e = F.lower(F.trim(explicit))
    active = F.size(F.filter(F.map_entries(params), lambda p: (p["key"] != "page") & p["value"].isNotNull() & ~p["value"].isin("", "all")))
    return (
        F.when((e != "") & e.contains("noindex"), F.when(e.contains("nofollow"), "noindex, nofollow").otherwise("noindex, follow")).when(e != "", "index, follow")
        .when(preview | (status != "published"), "noindex, follow").when(path.startswith("/admin") | path.startswith("/api") | path.startswith("/404"), "noindex, nofollow")
        .when((path == "/search") & (F.length(F.trim(F.coalesce(F.element_at(params, "q"), F.lit("")))) > 0), "noindex, follow").when(active >= 3, "noindex, follow")
        .when(total < F.coalesce(least, F.lit(1)), "noindex, follow").otherwise("index, follow")
    )


def may_submit(url: Column, content_type: Column) -> Column:
    """Whether a page may be submitted for indexing as a job posting: by its type, else by its path."""
    path = F.lower(F.regexp_extract(url, r"^(?:[a-z]+://[^/?#]*)?([^?#]*)", 1))
    other = reduce(Column.__or__, [path.startswith(p) for p in NOT_JOBS])
    return F.when(F.coalesce(content_type, F.lit("")) != "", content_type.isin("job", "government_job")).otherwise(~other & (path.startswith("/jobs/") | (path == "/jobs")))


def safe_url(url: Column) -> Column:
    """Http or https, and no local, private or link-local host."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    private = host.isin("localhost", "", "[::1]", "0.0.0.0") | host.rlike(r"^(127|10)\.|^192\.168\.|^169\.254\.|^172\.(1[6-9]|2[0-9]|3[01])\.|\.(local|internal|localhost)$|^\[f[cde]")
    return F.coalesce(url.rlike(r"(?i)^https?://") & ~private, F.lit(False))


def robots_rules(files: DataFrame, agent: str = "noticebot") -> DataFrame:
    """(origin, allow, pattern) from files(origin, body): the rules of the first group for the agent, else of the first for *."""
    lines = files.select("origin", F.posexplode(F.split("body", "\n")).alias("i", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"#.*$|\r", "")))
    pairs = lines.where(F.col("line").contains(":")).select("origin", "i", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("field"), F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("value"))
    upto = Window.partitionBy("origin").orderBy("i")
    grouped = pairs.withColumns({"agent": F.last(F.when(F.col("field") == "user-agent", F.lower("value")), ignorenulls=True).over(upto), "nth": F.sum((F.col("field") == "user-agent").cast("int")).over(upto)})
    groups = grouped.where((F.col("field") == "user-agent") & F.col("agent").isin(agent, "*")).groupBy("origin").agg(F.min_by("nth", F.struct(F.when(F.col("agent") == agent, 0).otherwise(1), "nth")).alias("nth"))
    rules = grouped.where(F.col("field").isin("allow", "disallow") & (F.col("value") != "")).join(groups, ["origin", "nth"])
    return rules.select("origin", (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"))


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls(origin, path, ...) with allowed: a matching allow wins, then a matching disallow, else yes. Rules of an origin are gathered first, so a URL stays one row."""
    regex = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace("pattern", r"([.+?^${}()|\[\]\\])", r"\\$1"), r"\*", ".*"))
    per = rules.withColumn("regex", regex).groupBy("origin").agg(F.collect_list(F.when(F.col("allow"), F.col("regex"))).alias("_allow"), F.collect_list(F.when(~F.col("allow"), F.col("regex"))).alias("_deny"))
    hit = lambda c: F.exists(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda r: F.regexp_like(F.col("path"), r))
    return urls.join(per, "origin", "left").withColumn("allowed", hit("_allow") | ~hit("_deny")).drop("_allow", "_deny")


def within_budget(calls: DataFrame, daily: int = 500, monthly: int = 15_000) -> DataFrame:
    """calls(id, created_at) with admitted: among the first of its day and of its month."""
    day = Window.partitionBy(F.to_date("created_at")).orderBy("created_at", "id")
    # the month's rank is its days' sizes before, plus the rank within the day: no task sorts a month
    ranked = calls.withColumn("_day", F.to_date("created_at")).withColumn("_in_day", F.row_number().over(day))
    sizes = calls.groupBy(F.to_date("created_at").alias("_day")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.trunc("_day", "month")).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = ranked.join(sizes.select("_day", before.alias("_before")), "_day")
    return out.withColumn("admitted", (F.col("_in_day") <= daily) & (F.col("_before") + F.col("_in_day") <= monthly)).drop("_day", "_in_day", "_before")
