"""URL filters: rules by host and path, then a list of canonical URLs behind a blocked Bloom filter.

Native: DataFrame functions only. The filter is a table of 256-bit blocks (four longs); a URL's first hash chooses its
block, its second sets six bits there. Building is one aggregation with bit_or, probing one join on the block. The probed
pages are written; possible hits alone go on to the exact join on the canonical URL, which removes false positives, and the
others pass it by. The list is a table of any size, a parameter.

Defined results. Null URL or one without ``://``: host and path empty, no rule, never listed. Repeated rows: each is
judged. An empty list blocks nothing. Nulls in the list are ignored. The rules are a parameter of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.shared import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
BITS_A_URL, BLOCK_BITS, PROBES = 16, 256, 6
#: Blocks of a filter that is broadcast: 2 MB of masks. A larger filter is joined by shuffle.
BROADCAST_BLOCKS = 1 << 16
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid)="


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www., path without a last slash or .html, parameters but for tracking, sorted; no scheme or fragment. Null where there is no host."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"(\.html|/)$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(host != "", F.concat_ws("?", F.concat(host, path), F.when(F.size(params) > 0, F.array_join(params, "&"))))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, on, prefix in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(prefix)
        rule, verdict = F.when(fits, on + prefix).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def _words(key: Column) -> list[Column]:
    """The four masks of a key within its block."""
    bits = F.xxhash64(F.lit(1), key)
    places = [F.shiftrightunsigned(bits, 8 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(PROBES)]
    masks = []
    for word in range(4):
        mask = F.lit(0).cast("long")
        for p in places:
            mask = mask.bitwiseOR(F.when(F.shiftright(p, 6) == word, F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long")))
        masks.append(mask)
    return masks


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), key), F.lit(blocks))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, f0..f3) from listed(canonical)."""
    masks = _words(F.col("canonical"))
    return listed.groupBy(_block(F.col("canonical"), blocks).alias("block")).agg(*[F.bit_or(m).alias(f"f{i}") for i, m in enumerate(masks)])


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, canonical, maybe (passed by the filter), listed, verdict for every row of pages(page_id, url)."""
    listed = cut(listed.select("canonical").where("canonical is not null").distinct(), "url-list")
    blocks = max(1, -(-listed.count() * BITS_A_URL // BLOCK_BITS))
    blocked = bloom(listed, blocks)
    if blocks <= BROADCAST_BLOCKS:
        blocked = F.broadcast(blocked)
    url = F.col("url")
    pages = pages.select("page_id", "url").withColumns({"host": host_of(url), "path": path_of(url), "canonical": canonical(url)})
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    pages = pages.withColumns({"rule": rule, "rule_verdict": verdict}).drop("url")
    probed = pages.withColumn("_block", _block(F.col("canonical"), blocks)).join(blocked, F.col("_block") == F.col("block"), "left")
    hit = F.lit(True)
    for i, m in enumerate(_words(F.col("canonical"))):
        hit = hit & (m.bitwiseAND(F.col(f"f{i}")) == m)
    probed = cut(probed.withColumn("maybe", F.coalesce((F.col("canonical").isNotNull()) & hit, F.lit(False))).select(*pages.columns, "maybe"), "url-probed")
    exact = listed.select(F.col("canonical").alias("_listed"))
    hits = probed.where("maybe").join(exact, F.col("canonical") == F.col("_listed"), "left").withColumn("listed", F.col("_listed").isNotNull()).drop("_listed")
    out = hits.unionByName(probed.where(~F.col("maybe")).withColumn("listed", F.lit(False)))
    return out.select("page_id", "host", "path", "rule", "canonical", "maybe", "listed", F.coalesce("rule_verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def listed_urls(pages: DataFrame) -> DataFrame:
    """The query's list, canonical: the URLs that stand for more than one body among all pages(url, html). No page shows by itself whether it is listed. Nulls are no body."""
    named = pages.select(canonical(F.col("url")).alias("canonical"), F.md5("html").alias("body")).where("canonical is not null")
    return named.groupBy("canonical").agg(F.min("body").alias("first"), F.max("body").alias("last")).where("first <> last").select("canonical")
