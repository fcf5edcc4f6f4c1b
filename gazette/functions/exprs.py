"""Column expressions of the notice domain: all built-in functions, so they stay within code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: aliases, patterns and scores that results depend on ----
ORGANIZATION_ALIASES = {
    "rrb": "railway recruitment board", "railway": "railway recruitment board", "railways": "railway recruitment board", "ssc": "staff selection commission",
    "upsc": "union public service commission", "ibps": "institute of banking personnel selection", "sbi": "state bank of india", "nta": "national testing agency",
    "bpsc": "bihar public service commission", "uppsc": "uttar pradesh public service commission", "rpsc": "rajasthan public service commission",
    "mppsc": "madhya pradesh public service commission", "drdo": "defence research and development organisation", "isro": "indian space research organisation",
    "kvs": "kendriya vidyalaya sangathan", "nvs": "navodaya vidyalaya samiti", "dsssb": "delhi subordinate services selection board",
    "ignou": "indira gandhi national open university", "ctet": "central teacher eligibility test",
}
EXAM_ALIASES = {
    "cgl": "combined graduate level", "chsl": "combined higher secondary level", "mts": "multi tasking staff", "cpo": "central police organisation", "je": "junior engineer",
    "gd": "general duty constable", "ntpc": "non technical popular categories", "alp": "assistant loco pilot", "group d": "group d level 1", "level 1": "group d level 1",
    "cse": "civil services examination", "nda": "national defence academy", "cds": "combined defence services", "po": "probationary officer", "clerk": "clerical cadre", "so": "specialist officer",
}
TITLE_ORGANIZATIONS = {
    "rrb|railway|railways": "Railway Recruitment Board", "ssc": "Staff Selection Commission", "upsc": "Union Public Service Commission", "ibps": "Institute of Banking Personnel Selection",
    "sbi": "State Bank of India", "nta": "National Testing Agency", "bpsc": "Bihar Public Service Commission", "uppsc": "Uttar Pradesh Public Service Commission",
    "rpsc": "Rajasthan Public Service Commission", "mppsc": "Madhya Pradesh Public Service Commission", "drdo": "DRDO", "isro": "ISRO", "dsssb": "DSSSB", "kvs": "Kendriya Vidyalaya Sangathan",
}
TITLE_EXAMS = {
    "cgl|combined graduate level": "CGL", r"chsl|10\+2": "CHSL", "mts|multi tasking": "MTS", "cpo|sub inspector": "CPO", "ntpc": "NTPC", "alp|loco pilot": "ALP", "group d|level 1": "Group D",
    "je|junior engineer": "Junior Engineer", "gd constable|gd": "GD Constable", "cse|civil services": "Civil Services", "nda": "NDA", "cds": "CDS", "po|probationary officer": "PO", "clerk": "Clerk",
}
NOTICE_NUMBER = r"\b(cen|advt\.?\s*no\.?|notification\s*no\.?|emp\s*no\.?)\s*[:\-\s]?\s*([0-9A-Za-z/\-]+)"
NOTICE_WORDS = "advt|advertisement|notice|notification|no|cen|en|emp"
SOURCE_HOSTS = {
    "official_government": ((".gov.in", ".nic.in", ".ac.in"), ("upsc.gov", "ssc.nic", "rrbcdg.gov")),
    "government_publication": ((), ("employmentnews", "ncs.gov", "pib.gov")),
    "established_aggregator": ((), ("sarkari", "result", "freejobalert", "jagranjosh")),
}
AUTHORITY = {"official_government": 100, "government_publication": 80, "established_aggregator": 60, "discovery_source": 30, "pdf": 30, "apply_url": 20, "recent": 10}
ROUTES = {"job": "jobs", "result": "results", "admit_card": "admit-card", "answer_key": "answer-key", "exam": "exams", "scholarship": "scholarships", "syllabus": "syllabus", "scheme": "schemes"}
LABELS = {"job": "Latest Job", "result": "Result", "admit_card": "Admit Card", "answer_key": "Answer Key", "exam": "Exam Date", "scholarship": "Scholarship", "syllabus": "Syllabus", "scheme": "Govt Scheme", "update": "Important Notice"}
FREQUENCY_SECONDS = {"10m": 600, "15m": 900, "30m": 1800, "1h": 3600, "hourly": 3600, "3h": 10800, "6h": 21600, "12h": 43200, "daily": 86400, "weekly": 604800}
RELEASED = {"result": "Result Released", "admit_card": "Admit Card Released", "answer_key": "Answer Key Released"}
NO_VALUE = ("", "null", "n/a", "not mentioned", "none", "undefined")
# ---- End of fixed values ----

BLANK = "[\\s ]+"


def cases(pairs: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first condition that holds."""
    out = None
    for condition, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out if otherwise is None else out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it, also where the optimizer moves it into filters or joins."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lookup(key: Column, values: dict, otherwise: object = None) -> Column:
    return cases([(key == k, v) for k, v in values.items()], otherwise)


def normalize_text(text: Column) -> Column:
    """Lower case; straight quotes and dashes; letters, digits, _ - / . kept; single blanks. ASCII input; others pass gazette.functions.text.decomposed first."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), "‘’“”–—", "''\"\"--")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^A-Za-z0-9_\s\-/. ]", " "), BLANK, " "))


def _word(alias: str) -> str:
    return rf"\b({alias})\b"


def organization_name(normal: Column) -> Column:
    """Full name of the first alias that stands in a normalized text as a word, else the text itself."""
    return let(normal, lambda x: cases([(x.rlike(_word(a)), full) for a, full in ORGANIZATION_ALIASES.items()], x))


def recruitment_name(normal: Column) -> Column:
    """Each alias in turn replaced once, at its first occurrence as a word of a normalized text."""
    for alias, full in EXAM_ALIASES.items():
        normal = F.regexp_replace(normal, rf"^(.*?)\b{alias}\b", f"$1{full}")
    return normal


def organization_in_title(normal: Column) -> Column:
    """From a normalized title."""
    return let(normal, lambda x: cases([(x.rlike(_word(p)), name) for p, name in TITLE_ORGANIZATIONS.items()]))


def exam_in_title(normal: Column) -> Column:
    """From a normalized title."""
    return let(normal, lambda x: cases([(x.rlike(_word(p)), name) for p, name in TITLE_EXAMS.items()]))


def number_in_title(title: Column) -> Column:
    return F.nullif(F.regexp_extract(title, "(?i)" + NOTICE_NUMBER, 2), F.lit(""))


def year_in(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\b(202[0-9]|203[0-9])\b", 1), F.lit("")).cast("int")


def notice_number(text: Column) -> Column:
    """Without the words for a notice; letters, digits, _ and / kept; null under two characters."""
    kept = F.regexp_replace(F.regexp_replace(normalize_text(text), _word(NOTICE_WORDS), ""), "[^A-Za-z0-9_/]", "")
    return let(kept, lambda x: F.when(F.length(x) >= 2, x))


def identity_string(*parts: Column) -> Column:
    full = [F.when(F.length(F.trim(p.cast("string"))) > 0, normalize_text(p.cast("string"))) for p in parts]
    return F.concat_ws("|", *full)


def vacancy_number(text: Column) -> Column:
    """All digits of the text as one number; null if none or 0."""
    n = F.nullif(F.regexp_replace(text, "[^0-9]", ""), F.lit("")).try_cast("bigint")
    return let(n, lambda x: F.when(x > 0, x))


def integer_prefix(text: Column) -> Column:
    """The leading digits as a number, 0 where there are none; null stays null."""
    n = F.coalesce(F.nullif(F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1), F.lit("")).try_cast("bigint"), F.lit(0))
    return F.when(text.isNotNull(), n)


def job_status(type_: Column, start: Column, last: Column, as_of: Column) -> Column:
    end_of_day = F.date_trunc("day", last) + F.expr("interval 1 day") - F.expr("interval 1 millisecond")
    released = [(type_ == t, s) for t, s in RELEASED.items()]
    return cases(
        [*released, (last.isNull() & start.isNull(), "Notification Released"), (start > as_of, "Upcoming"), (end_of_day < as_of, "Application Closed"), (end_of_day <= as_of + F.expr("interval 3 days"), "Closing Soon"), (last.isNotNull(), "Applications Open")],
        "Active",
    )


def slug(text: Column) -> Column:
    for pattern, by in ((BLANK, "-"), ("&", "-and-"), (r"[^A-Za-z0-9_\-]+", ""), ("-{2,}", "-"), ("^-+", ""), ("-+$", "")):
        text = F.regexp_replace(F.trim(F.lower(text)) if pattern == BLANK else text, pattern, by)
    return text


def route(type_: Column) -> Column:
    return lookup(type_, ROUTES, "important-updates")


def label(type_: Column) -> Column:
    return lookup(type_, LABELS, "Update")


def target_url(type_: Column, slug_: Column) -> Column:
    return F.concat(F.lit("/"), route(type_), F.lit("/"), slug_)


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def source_type(url: Column) -> Column:
    h = host(url)
    pairs = []
    for kind, (ends, parts) in SOURCE_HOSTS.items():
        for e in ends:
            pairs.append((h.endswith(e), kind))
        for p in parts:
            pairs.append((h.contains(p), kind))
    return cases(pairs, "discovery_source")


def authority_score(kind: Column, pdf: Column, apply_url: Column, recent: Column, config: dict = AUTHORITY) -> Column:
    base = lookup(kind, {k: v for k, v in config.items() if k in (*SOURCE_HOSTS, "discovery_source")}, config["discovery_source"])
    bonus = [F.when(flag, config[name]).otherwise(0) for flag, name in ((pdf, "pdf"), (apply_url, "apply_url"), (recent, "recent"))]
    return base + bonus[0] + bonus[1] + bonus[2]


def clean_content(html: Column) -> Column:
    """Text of a page without scripts, styles, comments, tags, clocks and counters; lower case, single blanks."""
    text = F.coalesce(html, F.lit(""))
    for tag in ("script", "style", "noscript", "svg", "iframe"):
        text = F.regexp_replace(text, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    for pattern in (r"(?s)<!--.*?-->", "<[^>]+>"):
        text = F.regexp_replace(text, pattern, " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        text = F.regexp_replace(text, f"(?i){entity}", char)
    days, months = "Mon|Tue|Wed|Thu|Fri|Sat|Sun", "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
    noise = (rf"\b(?:{days}),\s+\d{{1,2}}\s+(?:{months})\s+\d{{4}}\s+\d{{2}}:\d{{2}}:\d{{2}}\s+(?:GMT|IST|UTC)\b", r"\b\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM|IST)?\b", r"Visitor\s*Count\s*:\s*\d+", r"Page\s*Hits\s*:\s*\d+")
    for pattern in noise:
        text = F.regexp_replace(text, f"(?i){pattern}", " ")
    return F.lower(F.trim(F.regexp_replace(text, BLANK, " ")))


def content(html: Column) -> Column:
    """(fingerprint, length) of a page's clean content, which is made once; a page without any has its markup's fingerprint."""
    plain = F.trim(F.coalesce(html, F.lit("")))
    return let(clean_content(html), lambda c: F.struct(F.sha2(F.when(F.length(c) > 0, c).otherwise(plain), 256).alias("fingerprint"), F.length(c).cast("long").alias("length")))


def fingerprint(html: Column) -> Column:
    return content(html)["fingerprint"]


def without_no_value(text: Column) -> Column:
    """Null for the ways of saying nothing."""
    return F.when(~F.lower(F.trim(text)).isin(*NO_VALUE), F.trim(text))


def number_of(text: Column) -> Column:
    return F.nullif(F.regexp_replace(text, "[^0-9.]", ""), F.lit("")).try_cast("double")


def clamped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def section(markdown: Column, heading: str) -> Column:
    """The text under a ``##`` heading, up to the next."""
    return F.nullif(stripped(F.regexp_extract(markdown, rf"(?is)##[ \t]*{heading}[^\n]*\n(.*?)(?=\n##|\z)", 1)), F.lit(""))


def token_set(normal: Column) -> Column:
    """Distinct words of over one character of a normalized title."""
    return F.array_distinct(F.filter(F.split(normal, " "), lambda w: F.length(w) > 1))


def similarity(a_norm: Column, b_norm: Column, a_tokens: Column, b_tokens: Column) -> Column:
    """Jaccard similarity of token sets; 1 for equal texts, 0 where one has no tokens."""
    common = F.size(F.array_intersect(a_tokens, b_tokens))
    return F.when(a_norm == b_norm, 1.0).when((F.size(a_tokens) == 0) | (F.size(b_tokens) == 0), 0.0).otherwise(common / (F.size(a_tokens) + F.size(b_tokens) - common))


def each(array: str, place: bool = False) -> Column:
    """explode, or posexplode for place, as the outer of two nested ones. Spark compiles plain ones into one loop that gathers all its rows before it hands them on; a filter isn't compiled, so only an element's rows are gathered."""
    kept = F.filter(array, lambda x: x.isNotNull())
    return F.posexplode(kept) if place else F.explode(kept)
