"""Reading notices out of fetched bodies, and writing sitemaps and structured data. DataFrame functions but for URL resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.functions import exprs, text
from gazette.operators.listing import STATES
from gazette.operators.pages import numbered

#: A tag's attributes, and an anchor's with its content.
ANCHOR, TAG = r"(?is)<a(\s[^>]*)>(.*?)</a>", r"(?is)<{name}(\s[^>]*)>"
#: Where JSON feeds keep their records and a record's facts, in order of trial.
RECORD_KEYS = ("items", "data", "results", "notifications", "jobs", "posts", "articles", "records")
FACTS = {
    "title": ("title", "post_name", "subject", "name", "heading"),
    "link": ("url", "link", "href", "apply_url", "pdf_url", "document_url"),
    "description": ("description", "summary", "snippet"),
    "published": ("date", "created_at", "published_at", "publish_date"),
}


def _text(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), exprs.BLANK, " "))


def is_pdf(url: Column) -> Column:
    return F.lower(url).rlike(r"\.pdf([?#]|$)")


def _attribute(attributes: Column, name: str) -> Column:
    """The value of an attribute in either kind of quotes; null where it is missing or empty."""
    pattern = rf"""(?is)(?:^|\s){name}\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    return F.coalesce(*[F.nullif(F.regexp_extract(attributes, pattern, k), F.lit("")) for k in (1, 2)])


def html_links(pages: DataFrame, html: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """A2: key, pos, href, url, normalized_url, anchor, is_pdf: every different page that a page links to, by normalized URL, where it is first named.

    Links are resolved against the page; those of other schemes than http and https, and fragments, are left out.
    """
    pairs = F.arrays_zip(F.regexp_extract_all(F.col(html), F.lit(ANCHOR), 1).alias("attributes"), F.regexp_extract_all(F.col(html), F.lit(ANCHOR), 2).alias("label"))
    each = pages.select(key, F.coalesce(url, F.lit("")).alias("_base"), F.posexplode(pairs).alias("pos", "l")).select(key, "_base", (F.col("pos") + 1).alias("pos"), _attribute(F.col("l.attributes"), "href").alias("href"), F.col("l.label").alias("label"))
    resolved = each.withColumn("url", text.resolve_url(F.col("href"), F.col("_base"))).where("url is not null").withColumn("normalized_url", text.normalize_url(F.col("url")))
    first = F.row_number().over(Window.partitionBy(key, "normalized_url").orderBy("pos"))
    return resolved.withColumn("_r", first).where("_r = 1").select(key, "pos", "href", "url", "normalized_url", _text(F.col("label")).alias("anchor"), is_pdf(F.col("url")).alias("is_pdf"))


def page_facts(pages: DataFrame, html: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """A2: key, title, canonical link (resolved and normalized) and meta description; null where a page has none."""

    def first(tag: str, name: str, value: str, wanted: str) -> Column:
        tags = F.regexp_extract_all(F.col(html), F.lit(TAG.replace("{name}", tag)), 1)
        return F.get(F.filter(F.transform(tags, lambda t: F.when(F.lower(_attribute(t, name)) == value, _attribute(t, wanted))), lambda x: x.isNotNull()), F.lit(0))

    title = F.nullif(F.regexp_extract(F.col(html), r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit(""))
    out = pages.select(key, F.coalesce(url, F.lit("")).alias("_base"), _text(title).alias("title"), first("link", "rel", "canonical", "href").alias("_link"), exprs.stripped(first("meta", "name", "description", "content")).alias("description"))
    return out.select(key, "title", text.normalize_url(text.resolve_url(F.col("_link"), F.col("_base"))).alias("canonical_url"), "description")


def _entity(text: Column) -> Column:
    text = F.regexp_replace(text, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return exprs.stripped(text)


def _tag(block: Column, name: str) -> Column:
    return F.nullif(_entity(F.regexp_extract(block, rf"(?is)<{name}[^>]*>(.*?)</{name}>", 1)), F.lit(""))


def feed_items(feeds: DataFrame, body: str = "body", key: str = "source_id") -> DataFrame:
    """A3: key, pos, title, link, snippet, published: RSS items, or Atom entries where there are no items; an enclosure serves where a link is missing."""
    items = F.regexp_extract_all(F.col(body), F.lit(r"(?is)<item[\s>].*?</item>"), 0)
    entries = F.regexp_extract_all(F.col(body), F.lit(r"(?is)<entry[\s>].*?</entry>"), 0)
    each = feeds.select(key, F.posexplode(F.when(F.size(items) > 0, items).otherwise(entries)).alias("pos", "block"))
    b = F.col("block")
    href, enclosure = (F.nullif(_entity(F.regexp_extract(b, rf"""(?is)<{t}[^>]*{a}=["']([^"']+)["']""", 1)), F.lit("")) for t, a in (("link", "href"), ("enclosure", "url")))
    link = F.coalesce(_tag(b, "link"), href, enclosure)
    return each.select(key, "pos", F.coalesce(_tag(b, "title"), F.lit("Untitled Notification")).alias("title"), link.alias("link"), F.substring(F.coalesce(_tag(b, "description"), _tag(b, "summary"), F.lit("")), 1, 300).alias("snippet"), F.coalesce(_tag(b, "pubDate"), _tag(b, "updated")).alias("published")).where("link is not null")


def sitemap_entries(maps: DataFrame, body: str = "body", key: str = "source_id") -> DataFrame:
    """A4: key, kind, loc, lastmod: the urls, or the child sitemaps where there are none."""
    urls = F.regexp_extract_all(F.col(body), F.lit(r"(?is)<url[\s>].*?</url>"), 0)
    children = F.regexp_extract_all(F.col(body), F.lit(r"(?is)<sitemap[\s>].*?</sitemap>"), 0)
    each = maps.select(key, F.when(F.size(urls) > 0, "url").otherwise("sitemap").alias("kind"), F.explode(F.when(F.size(urls) > 0, urls).otherwise(children)).alias("block"))
    return each.select(key, "kind", _tag(F.col("block"), "loc").alias("loc"), _tag(F.col("block"), "lastmod").alias("lastmod")).where("loc is not null")


def json_items(feeds: DataFrame, body: str = "body", key: str = "source_id") -> tuple[DataFrame, DataFrame]:
    """A5: (key, pos, title, link, description, published) of records with a link, and (key, error) of bodies that aren't JSON."""
    parsed = feeds.withColumn("_v", F.try_parse_json(body))
    bad = parsed.where("_v is null").select(key, F.lit("Invalid JSON").alias("error"))
    root = F.from_json(F.col(body), "array<string>")
    inner = [F.from_json(F.get_json_object(F.col(body), f"$.{k}"), "array<string>") for k in RECORD_KEYS]
    listed = F.when(F.ltrim(F.col(body)).startswith("["), root).otherwise(F.coalesce(*inner))
    each = parsed.where("_v is not null").select(key, F.posexplode(listed).alias("pos", "record"))
    facts = [F.coalesce(*[F.nullif(F.get_json_object("record", f"$.{k}"), F.lit("")) for k in keys]).alias(name) for name, keys in FACTS.items()]
    out = each.select(key, "pos", *facts).where("link is not null").withColumn("title", F.coalesce("title", F.lit("Untitled Entry"))).withColumn("description", F.substring(F.coalesce("description", F.lit("")), 1, 300))
    return out, bad


def body_format(bodies: DataFrame) -> DataFrame:
    """bodies(url, content_type, body, declared) with format: pdf first, then what is declared, the body's beginning, and the content type."""
    head, kind, declared = F.lower(F.substring(F.ltrim(F.coalesce("body", F.lit(""))), 1, 500)), F.lower(F.coalesce("content_type", F.lit(""))), F.lower(F.coalesce("declared", F.lit("")))
    pairs = [
        (is_pdf(F.col("url")) | kind.contains("application/pdf"), "pdf"), (declared.isin("rss", "atom") | head.contains("<rss") | head.contains("<feed"), "rss"), ((declared == "sitemap") | head.contains("<urlset") | head.contains("<sitemapindex"), "sitemap"),
        ((declared == "json") | head.startswith("{") | head.startswith("[") | kind.contains("json"), "json"),
    ]
    return bodies.withColumn("format", exprs.cases(pairs, "html"))


def new_documents(files: DataFrame, archived: DataFrame, slug: str, year: int) -> DataFrame:
    """Files of the binaryFile source that are PDFs and whose checksum isn't archived, once each, with checksum and storage path."""
    pdf = files.where(F.substring("content", 1, 4) == F.lit(b"%PDF")).withColumn("checksum", F.sha2("content", 256))
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1), "[^A-Za-z0-9_-]+", "-")
    fresh = pdf.select("path", "length", "checksum", name.alias("_name")).groupBy("checksum").agg(F.min_by(F.struct("path", "length", "_name"), "path").alias("f")).select("checksum", "f.*")
    stored = F.concat(F.lit(f"{slug}/{year}/"), "_name", F.lit("-"), F.substring("checksum", 1, 8), F.lit(".pdf"))
    return fresh.join(archived.select("checksum"), "checksum", "left_anti").select("path", "length", "checksum", stored.alias("storage_path"))


#: Fixed values of the sitemap: sections with their type, other paths, and the names of states' pages.
SECTIONS = {"jobs": "job", "results": "result", "admit-card": "admit_card", "answer-key": "answer_key", "exams": "exam"}
STATIC_PATHS = ("/", "/about", "/contact", "/disclaimer", "/privacy-policy", "/terms", "/editorial-policy", "/correction-policy", "/scholarships", "/syllabus", "/schemes", "/important-updates")
#: URLs of a file, by the protocol.
FILE_URLS = 50_000


def sitemap(published: DataFrame, organizations: DataFrame, landing: DataFrame, states: tuple[str, ...] = STATES) -> DataFrame:
    """Kind, path, lastmod, changefreq, priority of the whole sitemap: each section with its items, organizations(id, slug, updated_at) with published items, states, landing(slug, is_indexable, updated_at) pages that may be indexed, and static paths.

    A section's lastmod is that of its newest item, by published_at, then id; a section without items is listed without.
    """
    spark = published.sparkSession
    row = lambda kind, path, lastmod, freq, priority: [kind.alias("kind"), path.alias("path"), lastmod.alias("lastmod"), freq.alias("changefreq"), priority.alias("priority")]
    number, none = lambda x: F.lit(float(x)), F.lit(None).cast("date")
    section = exprs.lookup(F.col("type"), {t: s for s, t in SECTIONS.items()})
    items = published.where(F.col("type").isin(*SECTIONS.values())).withColumn("_section", section)
    newest = F.min_by(F.to_date("updated_at"), F.struct(F.col("published_at").isNull().alias("last"), (-F.unix_micros("published_at")).alias("age"), "id"))
    sections = spark.createDataFrame([(s,) for s in SECTIONS], "_section string").join(items.groupBy("_section").agg(newest.alias("_day")), "_section", "left")
    own = F.to_date(F.coalesce("updated_at", "published_at"))
    used = published.select(F.col("organization_id").alias("id")).distinct()
    pages = [("organizations", "/organizations", "weekly", 0.8), ("states", "/states", "weekly", 0.8)]
    pages += [("states", f"/states/{s.lower().replace(' ', '-')}", "weekly", 0.7) for s in states]
    pages += [("static", p, "daily" if p == "/" else "monthly", 1.0 if p == "/" else 0.5) for p in STATIC_PATHS]
    fixed = spark.createDataFrame(pages, "kind string, path string, changefreq string, priority double")
    parts = [
        sections.select(*row(F.col("_section"), F.concat(F.lit("/"), "_section"), F.col("_day"), F.lit("daily"), number(0.9))),
        items.select(*row(F.col("_section"), F.concat(F.lit("/"), "_section", F.lit("/"), "slug"), own, F.lit("weekly"), number(0.8))),
        organizations.join(used, "id", "left_semi").select(*row(F.lit("organizations"), F.concat(F.lit("/organizations/"), "slug"), F.to_date("updated_at"), F.lit("weekly"), number(0.7))),
        landing.where("is_indexable").select(*row(F.lit("landing"), F.concat(F.lit("/jobs/"), "slug"), F.to_date("updated_at"), F.lit("daily"), number(0.85))),
        fixed.select(*row(F.col("kind"), F.col("path"), none, F.col("changefreq"), F.col("priority"))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def sitemap_files(entries: DataFrame, urls: int = FILE_URLS) -> DataFrame:
    """Entries of sitemap() with file, "<kind>-<number>" from 1 on, of at most urls entries each, by path. Numbers come from range partitions and the counts before them, so no kind is sorted in one task."""
    rows = numbered(entries, [F.asc("path"), F.asc("lastmod"), F.asc("priority")], "kind")
    return rows.withColumn("file", F.concat("kind", F.lit("-"), (F.expr(f"number div {urls}") + 1).cast("string"))).drop("number")


def _stamp(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _document(kind: str, *fields: Column) -> Column:
    """A JSON-LD object; keys without a value are left out."""
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit(kind).alias("@type"), *fields), {"ignoreNullFields": "true"})


def _typed(kind: str, *fields: Column) -> Column:
    return F.struct(F.lit(kind).alias("@type"), *fields)


# Fixed values of the documents: employer without an organization, employment type, country, currency, unit and zone of deadlines.
EMPLOYER, EMPLOYMENT, COUNTRY, CURRENCY, UNIT, DEADLINE = "Government of India", "FULL_TIME", "IN", "INR", "MONTH", "T23:59:59+05:30"


def structured_data(items: DataFrame, site: str, publisher: str) -> DataFrame:
    """Id, document: a JobPosting for a job, an Article for any other item.

    items(id, type, slug, title, meta_description, excerpt, published_at, created_at, updated_at, organization_name,
    organization_website, application_last_date, salary, qualification).
    """
    url = F.concat(F.lit(site.rstrip("/")), F.lit("/"), F.when(F.col("type") == "job", "jobs").otherwise(F.regexp_replace("type", "_", "-")), F.lit("/"), "slug")
    description = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("meta_description", "excerpt")], F.col("title"))
    posted = F.coalesce("published_at", "created_at")
    salary, deadline = F.nullif(F.col("salary").cast("string"), F.lit("")), F.date_format("application_last_date", "yyyy-MM-dd")
    job = _document(
        "JobPosting", F.col("title"), description.alias("description"), _stamp(posted).alias("datePosted"), url.alias("url"), F.lit(EMPLOYMENT).alias("employmentType"),
        _typed("Organization", F.coalesce("organization_name", F.lit(EMPLOYER)).alias("name"), F.col("organization_website").alias("sameAs")).alias("hiringOrganization"),
        _typed("Place", _typed("PostalAddress", F.lit(COUNTRY).alias("addressCountry")).alias("address")).alias("jobLocation"),
        F.concat(deadline, F.lit(DEADLINE)).alias("validThrough"),
        F.when(salary.isNotNull(), _typed("MonetaryAmount", F.lit(CURRENCY).alias("currency"), _typed("QuantitativeValue", salary.alias("value"), F.lit(UNIT).alias("unitText")).alias("value"))).alias("baseSalary"),
        F.nullif(F.col("qualification"), F.lit("")).alias("educationRequirements"),
    )
    article = _document(
        "Article", F.col("title").alias("headline"), description.alias("description"), _typed("WebPage", url.alias("@id")).alias("mainEntityOfPage"), _stamp(posted).alias("datePublished"),
        _stamp(F.coalesce("updated_at", posted)).alias("dateModified"), _typed("Organization", F.lit(f"{publisher} Editorial Desk").alias("name")).alias("author"), _typed("Organization", F.lit(publisher).alias("name"), F.lit(site.rstrip("/")).alias("url")).alias("publisher"),
    )
    return items.select("id", F.when(F.col("type") == "job", job).otherwise(article).alias("document"))


def organization_data(organizations: DataFrame, site: str) -> DataFrame:
    """Id, document: an Organization; organizations(id, name, website, logo_key)."""
    logo = F.concat(F.lit(f"{site.rstrip('/')}/api/documents/"), F.nullif(F.col("logo_key"), F.lit("")))
    return organizations.select("id", _document("Organization", F.col("name"), F.nullif(F.col("website"), F.lit("")).alias("url"), logo.alias("logo")).alias("document"))


def question_data(items: DataFrame, faq: str = "faq") -> DataFrame:
    """Id, document: an FAQPage of items(id, faq: array of (question, answer)); items without a whole question are left out."""
    pairs = F.transform(faq, lambda q: F.struct(exprs.stripped(q["question"]).alias("q"), exprs.stripped(q["answer"]).alias("a")))
    whole = items.select("id", F.filter(pairs, lambda x: (F.coalesce(x["q"], F.lit("")) != "") & (F.coalesce(x["a"], F.lit("")) != "")).alias("faq")).where("size(faq) > 0")
    entities = F.transform("faq", lambda x: _typed("Question", x["q"].alias("name"), _typed("Answer", x["a"].alias("text")).alias("acceptedAnswer")))
    return whole.select("id", _document("FAQPage", entities.alias("mainEntity")).alias("document"))
