"""Operators over change and event streams. Those that Spark can run as they are on both take either kind of DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Where redirects don't act.
PRIVATE_PATHS, MAINTENANCE = ("/admin", "/api", "/_astro"), "/maintenance"


def resolve_redirects(requests: DataFrame, redirects: DataFrame) -> DataFrame:
    """requests(path, ...) that an active redirect answers, in one row each, with from_path and to_path. One hop.

    A path that ends with a slash has two forms, as it is and without it. A redirect of the form as it is comes first; a
    target that is either form of the request is passed over; of several targets of one path the least counts. Paths of
    administration and interfaces aren't redirected.
    """
    usable = redirects.where("active and from_path is not null and to_path is not null and to_path <> ''")
    source, target = F.col("from_path"), F.col("to_path")
    stripped = F.when((F.length(source) > 1) & source.endswith("/"), F.expr("left(from_path, length(from_path) - 1)")).otherwise(source)
    # for requests of the path itself, and for those with one more slash
    to = usable.groupBy("from_path").agg(
        F.min(F.when((target != source) & (target != stripped), target)).alias("_direct"), F.min(F.when((target != source) & (target != F.concat(source, F.lit("/"))), target)).alias("_slashed")
    )
    path = F.col("path")
    public = (path != MAINTENANCE)
    for prefix in PRIVATE_PATHS:
        public = public & ~path.startswith(prefix)
    asked = requests.where(public).withColumn("_plain", F.when((F.length("path") > 1) & path.endswith("/"), F.expr("left(path, length(path) - 1)")))
    exact = to.where("_direct is not null").select(source.alias("_exact"), "_direct")
    other = to.where("_slashed is not null").select(source.alias("_other"), "_slashed")
    found = asked.join(exact, F.col("path") == F.col("_exact"), "left").join(other, F.col("_plain") == F.col("_other"), "left").where("_exact is not null or _other is not null")
    return found.withColumns({"from_path": F.coalesce("_exact", "_other"), "to_path": F.coalesce("_direct", "_slashed")}).drop("_plain", "_exact", "_direct", "_other", "_slashed")


def first_deliveries(events: DataFrame) -> DataFrame:
    """The first row of each event id, by seq."""
    return events.groupBy("event_id").agg(F.min_by(F.struct(*[c for c in events.columns if c != "event_id"]), "seq").alias("e")).select("event_id", "e.*")


def accept_new(batch: DataFrame, accepted: DataFrame) -> DataFrame:
    """T3 in foreachBatch: events of a batch that were never accepted, once each. accepted is the sink itself, so nothing is forgotten."""
    return first_deliveries(batch).join(accepted.select("event_id"), "event_id", "left_anti")


def subscription_state(events: DataFrame, days: int = 30) -> DataFrame:
    """T4: status by the last event; the period runs from the last event that isn't a cancellation."""
    status = F.when(F.col("kind") == "cancelled", "cancelled").otherwise("active")
    end = F.max(F.when(F.col("kind") != "cancelled", F.col("ts"))) + F.expr(f"interval {days} days")
    return events.groupBy("subscription_id").agg(F.max_by(status, F.struct("ts", "seq")).alias("status"), end.alias("period_end"))


def subscription_lifecycle(events: DataFrame, as_of: str, days: int = 30, keep: int = 7) -> DataFrame:
    """subscription_state() as time goes on without events: at as_of an active subscription past its period is expired; those more than keep days past it (or past their last event, if they never had a period) are purged, that is, left out."""
    state = subscription_state(events, days).join(events.groupBy("subscription_id").agg(F.max("ts").alias("_last")), "subscription_id")
    now = F.lit(as_of).cast("timestamp")
    left = state.where(F.coalesce("period_end", "_last") + F.expr(f"interval {keep} days") > now)
    return left.select("subscription_id", F.when((F.col("status") == "active") & (F.col("period_end") <= now), "expired").otherwise(F.col("status")).alias("status"), "period_end")


def latest_pages(observed: DataFrame, *keys: str) -> DataFrame:
    """One row a key: the last seen, of equally late ones that with the greatest fingerprint, then URLs."""
    rest = [c for c in observed.columns if c not in keys]
    order = F.struct("seen_at", "fingerprint", *[c for c in ("normalized_url", "canonical_url") if c in rest])
    return observed.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("p")).select(*keys, "p.*")


def page_changes(snapshot: DataFrame, observed: DataFrame) -> DataFrame:
    """observed(source_id, normalized_url, canonical_url, fingerprint, ...) with page_status NEW, UPDATED or UNCHANGED against snapshot, by normalized URL, else by canonical URL (its page with the least URL); page_url, the URL of the page that was found, else its own; and whether a new page repeats another's content."""
    by_url = snapshot.select("source_id", "normalized_url", F.col("fingerprint").alias("_by_url")).dropDuplicates(["source_id", "normalized_url"])
    by_canonical = snapshot.where("canonical_url is not null").groupBy("source_id", "canonical_url").agg(F.min(F.struct("normalized_url", "fingerprint")).alias("_page"))
    by_canonical = by_canonical.select("source_id", "canonical_url", F.col("_page.normalized_url").alias("_canonical_page"), F.col("_page.fingerprint").alias("_by_canonical"))
    known = snapshot.select("source_id", "fingerprint").distinct().withColumn("_known", F.lit(True))
    out = observed.join(by_url, ["source_id", "normalized_url"], "left").join(by_canonical, ["source_id", "canonical_url"], "left").join(known, ["source_id", "fingerprint"], "left")
    was = F.coalesce("_by_url", "_by_canonical")
    status = F.when(was.isNull(), "NEW").when(was != F.col("fingerprint"), "UPDATED").otherwise("UNCHANGED")
    same = F.when(was.isNull(), F.coalesce("_known", F.lit(False))).otherwise(was == F.col("fingerprint"))
    page = F.when(F.col("_by_url").isNull(), F.coalesce("_canonical_page", "normalized_url")).otherwise(F.col("normalized_url"))
    return out.withColumns({"page_status": status, "repeats_content": same, "page_url": page}).drop("_by_url", "_by_canonical", "_canonical_page", "_known")


def redirect_hits(requests: DataFrame, redirects: DataFrame) -> DataFrame:
    """Hits and last access of each redirect; on a stream in update mode."""
    return resolve_redirects(requests, redirects).groupBy("from_path", "to_path").agg(F.count("*").alias("hits"), F.max("ts").alias("last_access"))


def search_hits(events: DataFrame) -> DataFrame:
    """Hits, last results count and time by normalized query; batch, or a stream in update mode that foreachBatch upserts."""
    query = F.lower(F.trim("query"))
    return events.withColumn("query", query).where(F.length("query").between(2, 80)).groupBy("query").agg(F.count("*").alias("hits"), F.max_by("results_count", "ts").alias("last_results"), F.max("ts").alias("last_seen"))


def daily(events: DataFrame, at: str, late: str = "1 day", **sums) -> DataFrame:
    """Tumbling days; on a stream rows later than the watermark are dropped."""
    if events.isStreaming:
        events = events.withWatermark(at, late)
    return events.groupBy(F.window(at, "1 day").alias("w")).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in sums.items()]).select(F.col("w.start").alias("day"), "n", *sums)


def toggles(events: DataFrame) -> DataFrame:
    """Members after toggling: those with an odd number of events, since the last."""
    return events.groupBy("user_id", "target_id").agg(F.count("*").alias("n"), F.max("ts").alias("since")).where("n % 2 = 1").drop("n")


def read_state(notifications: DataFrame, one: DataFrame, all_: DataFrame) -> DataFrame:
    """Notifications with is_read: marked themselves, or by a mark of all that isn't older than they are. one(notification_id, ts), all_(user_id, ts)."""
    single = one.groupBy(F.col("notification_id").alias("id")).agg(F.max("ts").alias("_one"))
    every = all_.groupBy("user_id").agg(F.max("ts").alias("_all"))
    out = notifications.join(single, "id", "left").join(every, "user_id", "left")
    return out.withColumn("is_read", F.coalesce(F.col("_one") >= F.col("created_at"), F.lit(False)) | F.coalesce(F.col("_all") >= F.col("created_at"), F.lit(False))).drop("_one", "_all")


def unexpired(rows: DataFrame, as_of: str, expires: str = "expires_at", days: int = 7) -> DataFrame:
    """Rows that aren't more than days past their expiry."""
    return rows.where(F.col(expires).isNull() | (F.col(expires) >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days")))


def _buckets(logs: DataFrame) -> DataFrame:
    """(source_id, day, carried): per source and day with logs, the failures in a row before it. A source's days are few, however many rows they hold."""
    last_ok = F.max(F.when(F.col("ok"), F.struct("ts", "run_id")))
    days = logs.withColumn("day", F.to_date("ts")).groupBy("source_id", "day").agg(F.count("*").alias("n"), last_ok.alias("last_ok"))
    after = logs.withColumn("day", F.to_date("ts")).join(days.where("last_ok is not null").select("source_id", "day", "last_ok"), ["source_id", "day"]).where(F.struct("ts", "run_id") > F.col("last_ok")).groupBy("source_id", "day").agg(F.count("*").alias("after"))
    days = days.join(after, ["source_id", "day"], "left").withColumn("failures", F.when(F.col("last_ok").isNull(), F.col("n")).otherwise(F.coalesce("after", F.lit(0))))
    order = Window.partitionBy("source_id").orderBy("day")
    days = days.withColumn("island", F.sum(F.col("last_ok").isNotNull().cast("int")).over(order))
    upto = F.sum("failures").over(Window.partitionBy("source_id", "island").orderBy("day"))
    return days.withColumn("upto", upto).select("source_id", "day", F.coalesce(F.lag("upto").over(order), F.lit(0)).alias("carried"), "upto")


def failure_runs(logs: DataFrame) -> DataFrame:
    """logs(source_id, ts, run_id, ok) with the number of failures in a row up to each. Rows are ordered within a source's day; days are linked by their counts."""
    order = Window.partitionBy("source_id", "_day").orderBy("ts", "run_id")
    rows = logs.withColumn("_day", F.to_date("ts")).withColumn("_island", F.sum(F.col("ok").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("source_id", "_day", "_island").orderBy("ts", "run_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_n", F.sum((~F.col("ok")).cast("int")).over(inside))
    carried = _buckets(logs).select(F.col("source_id").alias("_s"), F.col("day").alias("_d"), "carried")
    rows = rows.join(carried, F.col("source_id").eqNullSafe(F.col("_s")) & F.col("_day").eqNullSafe(F.col("_d")), "left")
    return rows.withColumn("failures_in_a_row", F.col("_n") + F.when(F.col("_island") == 0, F.coalesce("carried", F.lit(0))).otherwise(0)).drop("_day", "_island", "_n", "_s", "_d", "carried")


#: A mean is known to fewer steps than this: so many halvings take any response time under 2^40 ms below one.
_STEPS = 41


def _days(logs: DataFrame) -> DataFrame:
    """A row for each source and day, from one pass over logs: failures at its end, whether any succeeded, last response and success, and the day as a map of the mean before it to the mean after it.

    Over 41 rows or more such a map has two values at most, as each step halves the range: low, and low + 1 from some mean
    on, which follows backwards, as the least mean before a step that reaches y after it is 2 y - x - 1. A day of fewer rows
    is kept as its rows. So no array holds more than a day, and a source's days are few.
    """
    x = F.col("response_ms").cast("long")
    row = F.struct("ts", "run_id", x.alias("x"), F.coalesce("ok", F.lit(False)).alias("ok"))
    days = logs.groupBy("source_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    good = F.filter("rows", lambda r: r["ok"])
    days = days.select(
        "source_id", "day", (F.size(good) > 0).alias("any_ok"), F.element_at("rows", -1)["x"].alias("last_ms"), F.array_max(F.transform(good, lambda r: r["ts"])).alias("last_success"),
        F.when(F.size(good) == 0, F.size("rows")).otherwise(F.array_position(F.reverse(F.transform("rows", lambda r: r["ok"])), True) - 1).cast("long").alias("failures"),
        F.transform(F.filter("rows", lambda r: r["x"].isNotNull()), lambda r: r["x"]).alias("xs"),
    )
    zero = F.lit(0).cast("long")
    alone = F.aggregate("xs", zero, lambda m, v: F.when(m == 0, v).otherwise(F.floor((m + v + 1) / 2)))
    low = _floored(F.col("xs"), F.lit(1).cast("long"))
    back = F.aggregate(F.reverse("xs"), F.col("low") + 1, lambda y, v: F.when(y > (1 << 41), y).otherwise(F.greatest(2 * y - v - 1, zero)))
    days = days.withColumns({"n": F.size("xs"), "alone": alone, "low": low})
    return days.withColumn("from", F.when(F.col("n") >= _STEPS, back)).withColumn("xs", F.when(F.col("n") < _STEPS, F.col("xs")))


def _floored(xs, start):
    return F.aggregate(xs, start, lambda m, v: F.floor((m + v + 1) / 2))


def _mean(days):
    by_day = lambda m, d: F.when(m == 0, d["alone"]).when(d["n"] >= _STEPS, d["low"] + (m >= d["from"]).cast("long")).otherwise(_floored(d["xs"], m))
    return F.when(F.exists(days, lambda d: d["n"] > 0), F.aggregate(days, F.lit(0).cast("long"), by_day)).cast("double")


def _by_source(logs: DataFrame) -> DataFrame:
    days = _days(logs)
    return days.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("day", *[c for c in days.columns if c not in ("source_id", "day")]))).alias("days"))


def response_means(logs: DataFrame) -> DataFrame:
    """Per source the response times folded in order: mean -> round((mean + x) / 2), halves up. Rows without a time are passed over."""
    return _by_source(logs).select("source_id", _mean(F.col("days")).alias("mean_ms"))


def source_health(logs: DataFrame) -> DataFrame:
    """Per source: failures at the end, mean response, last response (null where the last row has none), last success, and health by failures and the last response."""
    failures = F.aggregate("days", F.lit(0).cast("long"), lambda n, d: F.when(d["any_ok"], d["failures"]).otherwise(n + d["failures"]))
    out = _by_source(logs).select("source_id", failures.alias("failures"), _mean(F.col("days")).alias("mean_ms"), F.element_at("days", -1)["last_ms"].alias("last_ms"), F.array_max(F.transform("days", lambda d: d["last_success"])).alias("last_success"))
    return out.withColumn("health", F.when(F.col("failures") >= 3, "failed").when((F.col("failures") > 0) | (F.col("last_ms") > 5000), "warning").otherwise("healthy"))
