"""Listings, search, hubs, pages and related items over published notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.functions import exprs

#: Names of states that hubs are made for.
STATES = (
    "Andhra Pradesh", "Assam", "Bihar", "Chandigarh", "Chhattisgarh", "Delhi", "Gujarat", "Haryana", "Himachal Pradesh", "Jharkhand", "Karnataka", "Kerala",
    "Madhya Pradesh", "Maharashtra", "Odisha", "Punjab", "Rajasthan", "Tamil Nadu", "Telangana", "Uttar Pradesh", "Uttarakhand", "West Bengal",
)
HOME_LIMITS = {"job": 8, "result": 6, "admit_card": 6, "answer_key": 6}


def newest(*more: str) -> list[Column]:
    return [F.desc_nulls_last("published_at"), F.desc_nulls_last("created_at"), *[F.asc(c) for c in more or ("id",)]]


def star(items: DataFrame, jobs: DataFrame, organizations: DataFrame, categories: DataFrame, as_of: str, published_only: bool = True) -> DataFrame:
    """Items with their job, organization and category, and the status at as_of. Sizes decide which sides are broadcast."""
    if published_only:
        items = items.where("status = 'published'")
    j = jobs.select("content_item_id", "post_name", "vacancy", "qualification", "application_start", "application_last_date")
    o = organizations.selectExpr("id as organization_id", "name as organization_name", "slug as organization_slug")
    c = categories.selectExpr("id as category_id", "name as category_name", "slug as category_slug")
    out = items.join(j, items["id"] == j["content_item_id"], "left").drop("content_item_id").join(o, "organization_id", "left").join(c, "category_id", "left")
    return out.withColumn("calculated_status", exprs.job_status(F.col("type"), F.col("application_start"), F.col("application_last_date"), F.lit(as_of).cast("timestamp")))


def like(column: str, text: str, escape: bool = False) -> Column:
    """Contains text, in either case. % and _ of the text are wildcards unless escaped."""
    if escape:
        for c in "\\%_":
            text = text.replace(c, "\\" + c)
    return F.col(column).ilike(f"%{text}%")


def filtered(public: DataFrame, type: str | None = None, organization: str | None = None, category: str | None = None, qualification: str | None = None, state: str | None = None, days: int | None = None, as_of: str | None = None, text: str | None = None) -> DataFrame:
    """The conjunction of the filters that are given."""
    conditions = [
        (type, lambda: F.col("type") == type),
        (organization, lambda: F.col("organization_slug") == organization),
        (category, lambda: F.col("category_slug") == category),
        (qualification, lambda: like("qualification", qualification)),
        (state, lambda: like("title", state) | like("organization_name", state)),
        (text, lambda: like("title", text) | like("organization_name", text) | like("post_name", text) | like("category_name", text)),
        (days, lambda: F.col("published_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days")),
    ]
    for given, condition in conditions:
        if given:
            public = public.where(condition())
    return public


def order(sort: str = "latest") -> list[Column]:
    """E2. Ties go to the id."""
    if sort == "deadline":
        return [F.asc_nulls_last("application_last_date"), F.asc("id")]
    if sort == "vacancies":
        return [exprs.integer_prefix(F.col("vacancy")).desc_nulls_last(), F.asc("id")]
    return newest()


def page_of(rows: DataFrame, by: list[Column], page: int = 1, limit: int = 12) -> DataFrame:
    """A page, with total, total_pages, has_next and has_prev. The total is a count of its own, not a window over all rows."""
    page, limit = max(page, 1), min(max(limit, 1), 50)
    total = rows.agg(F.count("*").alias("total"))
    out = rows.orderBy(*by).offset((page - 1) * limit).limit(limit).join(F.broadcast(total))  # one row
    pages = F.ceil(F.col("total") / limit).cast("long")
    return out.withColumns({"page": F.lit(page), "total_pages": pages, "has_next": F.lit(page) < pages, "has_prev": F.lit(page > 1)})


def state_hubs(public: DataFrame, states: tuple[str, ...] = STATES) -> DataFrame:
    """Per state that occurs, the number of items in all and by type. Every item is read once: its states are an array."""
    text = F.lower(F.concat_ws("\n", "title", "organization_name"))
    hits = F.array_compact(F.array(*[F.when(text.contains(s.lower()), F.lit(s)) for s in states]))
    each = public.select("type", F.explode(hits).alias("state"))
    return each.groupBy("state").agg(F.count("*").alias("total"), *[F.count_if(F.col("type") == t).alias(n) for t, n in (("job", "jobs"), ("result", "results"), ("admit_card", "admit_cards"), ("exam", "exams"))])


def by_slug(requests: DataFrame, items: DataFrame) -> DataFrame:
    """requests(type, slug, allow_preview) with the item's id, or null."""
    found = items.select(F.col("type").alias("_type"), F.col("slug").alias("_slug"), "id", "status")
    hit = (F.col("type") == F.col("_type")) & (F.col("slug") == F.col("_slug")) & ((F.col("status") == "published") | F.col("allow_preview"))
    return requests.join(found, hit, "left").drop("_type", "_slug")


def organization_hubs(public: DataFrame) -> DataFrame:
    """B7."""
    counts = [F.count_if(F.col("type") == t).alias(n) for t, n in (("job", "jobs"), ("result", "results"), ("admit_card", "admit_cards"), ("answer_key", "answer_keys"))]
    return public.where("organization_id is not null").groupBy("organization_id", "organization_name", "organization_slug").agg(F.count("*").alias("total"), *counts)


def browse(rows: DataFrame, filters: dict[str, object] | None = None, by: list[Column] | None = None, limit: int = 50) -> DataFrame:
    """Rows equal to the filters that aren't None, newest first by default."""
    for column, value in (filters or {}).items():
        if value is not None:
            rows = rows.where(F.col(column) == F.lit(value))
    return rows.orderBy(*(by or [F.desc_nulls_last("created_at"), F.asc("id")])).limit(limit)


def review_queue(items: DataFrame, limit: int = 50) -> DataFrame:
    """B8."""
    conflict = F.col("duplicate_status") == "conflict"
    due = items.where((F.col("status") == "review") | (F.col("verification_status") == "verification_required") | conflict | (F.col("quality_score") < 90))
    return due.orderBy(F.when(conflict, 0).otherwise(1), F.desc_nulls_last("created_at"), "id").limit(limit)


def library(saved: DataFrame, public: DataFrame) -> DataFrame:
    """Per user, saved published items in all and by type."""
    rows = saved.join(public.selectExpr("id as content_item_id", "type"), "content_item_id")
    return rows.groupBy("user_id").agg(F.count("*").alias("saved"), *[F.count_if(F.col("type") == t).alias(f"saved_{t}") for t in ("job", "result", "admit_card", "answer_key")])


def newest_per_type(public: DataFrame, limits: dict[str, int] = HOME_LIMITS) -> DataFrame:
    """One scan; the n newest of each type, n by type."""
    rank = F.row_number().over(Window.partitionBy("type").orderBy(*newest()))
    wanted = public.where(F.col("type").isin(*limits))
    # the common limit reaches the scan's side of the shuffle as a group limit
    return wanted.withColumn("rank", rank).where(F.col("rank") <= max(limits.values())).where(F.col("rank") <= exprs.lookup(F.col("type"), limits))


def closing_soon(public: DataFrame, as_of: str, limit: int = 6) -> DataFrame:
    """E4, C1."""
    return public.where((F.col("type") == "job") & (F.col("application_last_date") >= F.date_trunc("day", F.lit(as_of).cast("timestamp")))).orderBy("application_last_date", "id").limit(limit)


def recently_updated(public: DataFrame, limit: int = 6) -> DataFrame:
    """E5."""
    return public.where("updated_at > created_at").orderBy(F.desc("updated_at"), "id").limit(limit)


def related(public: DataFrame, n: int = 6, strict: bool = False) -> DataFrame:
    """For every item up to n others: of its organization, then its category, then its type; newest first within a tier.

    strict: a tier is asked for no more than the places that the tiers before it have left, and what it repeats of them isn't made up
    for, so there may be fewer than n. Candidates are capped at n + 1 a key before the join, as an item needs n besides itself, so
    rows stay in proportion to items.
    """
    tiers = []
    for tier, key in enumerate(("organization_id", "category_id", "type"), 1):
        keyed = public.where(F.col(key).isNotNull())
        top = keyed.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*newest()))).where(F.col("_r") <= n + 1)
        # three tiers may give the same candidate, so each offers enough for all
        candidates = top.select(F.col(key).alias("_key"), F.col("id").alias("related_id"), F.col("published_at").alias("_at"), F.col("created_at").alias("_made"), "_r")
        tiers.append(keyed.select("id", F.col(key).alias("_own")).join(candidates, F.col("_own") == F.col("_key")).where("id <> related_id").select("id", "related_id", "_at", "_made", "_r", F.lit(tier).alias("tier")))
    every = tiers[0].unionByName(tiers[1]).unionByName(tiers[2])
    if strict:
        of = lambda t: F.transform(F.array_sort(F.collect_list(F.when(F.col("tier") == t, F.struct("_r", "related_id")))), lambda x: x["related_id"])
        lists = every.groupBy("id").agg(*[of(t).alias(f"_{t}") for t in (1, 2, 3)])  # at most n + 1 of each tier
        lists = lists.withColumn("_1", F.slice("_1", 1, n))
        lists = lists.withColumn("_2", F.array_except(F.slice("_2", F.lit(1), n - F.size("_1")), "_1"))
        lists = lists.withColumn("_3", F.array_except(F.slice("_3", F.lit(1), n - F.size("_1") - F.size("_2")), F.concat("_1", "_2")))
        named = F.concat(*[F.arrays_zip(F.col(f"_{t}").alias("related_id"), F.array_repeat(F.lit(t), F.size(f"_{t}")).alias("tier")) for t in (1, 2, 3)])
        return lists.select("id", F.posexplode(named).alias("rank", "r")).select("id", "r.related_id", "r.tier", (F.col("rank") + 1).alias("rank"))
    best = every.groupBy("id", "related_id", "_at", "_made").agg(F.min("tier").alias("tier"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("tier", F.desc_nulls_last("_at"), F.desc_nulls_last("_made"), "related_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= n).select("id", "related_id", "tier", "rank")


def inbox(notifications: DataFrame, items: DataFrame, n: int = 50) -> DataFrame:
    """The n newest notifications of each user with the item's slug and type, and the user's number of unread ones."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), "id"))
    unread = notifications.groupBy("user_id").agg(F.count_if(F.col("read_at").isNull()).alias("unread"))
    shown = notifications.withColumn("rank", rank).where(F.col("rank") <= n)
    return shown.join(items.selectExpr("id as content_item_id", "slug as item_slug", "type as item_type"), "content_item_id", "left").join(unread, "user_id")


def live_sponsored(items: DataFrame, as_of: str) -> DataFrame:
    """sponsored(starts_at, ends_at, active) rows whose open-ended window holds as_of."""
    at = F.lit(as_of).cast("timestamp")
    return items.where(F.col("active") & (F.coalesce(F.col("starts_at"), at) <= at) & (F.coalesce(F.col("ends_at"), at) >= at))


def capped(discovered: DataFrame, n: int = 25) -> DataFrame:
    """The first n rows of each source in document order."""
    return discovered.withColumn("_r", F.row_number().over(Window.partitionBy("source_id").orderBy("pos"))).where(F.col("_r") <= n).drop("_r")


def pending_pages(pages: DataFrame, items: DataFrame, limit: int = 10) -> DataFrame:
    """C4: pages without an item, or whose item is a draft or pending, or that changed since; newest first. Of several items of a URL the newest counts, so a page is one row."""
    last = items.groupBy(F.col("source_url").alias("_url")).agg(F.max_by(F.struct("status", "updated_at"), F.struct("updated_at", "id")).alias("i"))
    out = pages.join(last, F.col("url") == F.col("_url"), "left")
    due = F.col("_url").isNull() | F.col("i.status").isin("draft", "review") | (F.col("last_changed_at") > F.col("i.updated_at"))
    return out.where(due).orderBy(F.desc("last_changed_at"), "id").limit(limit).drop("_url", "i")


def discovered(*parts: DataFrame) -> DataFrame:
    """What the parsers of different formats found, as one table; columns that a format lacks are null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
