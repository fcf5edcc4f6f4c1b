"""Column functions that no built-in expresses: Arrow-batched pandas UDFs over URLs, Unicode and JSON."""

from __future__ import annotations

import json
import re
import unicodedata
from urllib.parse import parse_qsl, quote, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.functions import exprs

# ---- Fixed values ----
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "msclkid", "_ga", "_gl", "mc_cid", "mc_eid", "ref", "source", "trk", "si")
SITE_TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "ref", "source", "_ga", "mc_cid", "mc_eid")
NOT_CRAWLED = ("#", "javascript:", "mailto:", "tel:", "data:", "sms:", "whatsapp:", "tg:", "file:", "ftp:")
SECRET_KEYS = ("password", "token", "secret", "api_key", "apikey", "authorization", "cookie", "session", "credential", "private_key", "access_key", "signature", "salt", "bearer")
# ---- End of fixed values ----
DEFAULT_PORTS = {"http": 80, "https": 443}


def normalized_url(url: str) -> str:
    """Lower scheme and host, no default port, fragment, tracking parameter or last slash; parameters sorted by name. A text that is no URL loses its fragment only."""
    text = url.strip()
    try:
        parts = urlsplit(text)
        port = parts.port
        if not parts.scheme or not parts.hostname:
            raise ValueError(text)
    except ValueError:
        return re.sub(r"#.*$", "", text)
    scheme, host = parts.scheme.lower(), parts.hostname.lower()
    netloc = host if port is None or DEFAULT_PORTS.get(scheme) == port else f"{host}:{port}"
    params = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k.lower() not in TRACKING]
    path = parts.path or "/"
    if len(path) > 1 and path.endswith("/"):
        path = path[:-1]
    return urlunsplit((scheme, netloc, quote(path, safe="/%:@!$&'()*+,;=~-._"), urlencode(sorted(params, key=lambda p: p[0])), ""))


def resolved_url(link: str, base: str) -> str | None:
    """The link against its page; null unless http or https."""
    text = link.strip()
    if not text or text.lower().startswith(NOT_CRAWLED):
        return None
    try:
        url = urljoin(base, text)
        parts = urlsplit(url)
    except ValueError:
        return None
    return url if parts.scheme in ("http", "https") and parts.netloc else None


def site_url(url: str, host: str) -> str:
    """Canonical form on one's own site: https, its host, lower path with single slashes and no last one, no tracking parameters."""
    parts = urlsplit(url.strip())
    path = re.sub("/{2,}", "/", parts.path.lower()) or "/"
    path = path if path.startswith("/") else "/" + path
    if len(path) > 1:
        path = path.rstrip("/") or "/"
    params = sorted((k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k.lower() not in SITE_TRACKING)
    return urlunsplit(("https", host, path, urlencode(params), ""))


def masked_json(text: str) -> str:
    """JSON with the values of secret-like keys masked, at any depth. Text that isn't JSON stays."""

    def mask(x):
        if isinstance(x, dict):
            return {k: "***" if any(s in k.lower() for s in SECRET_KEYS) else mask(v) for k, v in x.items()}
        return [mask(v) for v in x] if isinstance(x, list) else x

    try:
        return json.dumps(mask(json.loads(text)), separators=(",", ":"), ensure_ascii=False)
    except (ValueError, RecursionError):
        return text


def with_links(text: str, anchors: list, most: int = 3) -> str:
    """At most most Markdown links: the first whole-word occurrence of each anchor of four characters or more that stands outside links."""
    done = 0
    for anchor, url in anchors:
        if done == most or len(anchor) < 4:
            continue
        spans = [m.span() for m in re.finditer(r"\[[^\]]*\]\([^)]*\)|<a\s.*?</a>", text, re.S | re.I)]
        for m in re.finditer(rf"(?<!\w){re.escape(anchor)}(?!\w)", text, re.I):
            if not any(a <= m.start() < b for a, b in spans):
                text = f"{text[: m.start()]}[{m.group(0)}]({url}){text[m.end() :]}"
                done += 1
                break
    return text


def _series(f, *columns: pd.Series) -> pd.Series:
    return pd.Series([None if any(x is None for x in row) else f(*row) for row in zip(*columns, strict=True)], dtype=object)


def normalize_url(url: Column) -> Column:
    """G1."""

    def run(urls: pd.Series) -> pd.Series:
        return _series(normalized_url, urls)

    return F.pandas_udf(run, "string")(url)


def resolve_url(link: Column, base: Column) -> Column:
    """G2."""

    def run(links: pd.Series, bases: pd.Series) -> pd.Series:
        return _series(resolved_url, links, bases)

    return F.pandas_udf(run, "string")(link, base)


def canonical_site_url(url: Column, host: str) -> Column:
    """G3."""

    def run(urls: pd.Series) -> pd.Series:
        return _series(lambda u: site_url(u, host), urls)

    return F.pandas_udf(run, "string")(url)


def decomposed(text: Column) -> Column:
    """NFKD; ASCII texts, which it leaves as they are, are masked out of the UDF's work."""

    def run(texts: pd.Series) -> pd.Series:
        return _series(lambda t: unicodedata.normalize("NFKD", t), texts)

    return F.coalesce(F.pandas_udf(run, "string")(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def normalize_any_text(text: Column) -> Column:
    """G6 for any script."""
    return exprs.normalize_text(decomposed(text))


def mask_secrets(text: Column) -> Column:
    """The whole masked JSON."""

    def run(texts: pd.Series) -> pd.Series:
        return _series(masked_json, texts)

    return F.pandas_udf(run, "string")(text)


def cut_message(message: Column, most: int = 1000) -> Column:
    """The message of an error is cut, its metadata is not."""
    return F.substring(message, 1, most)


def inject_links(text: Column, anchors: Column, most: int = 3) -> Column:
    """Anchors is an array of (anchor, url), best first."""

    def run(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return _series(lambda t, a: with_links(t, [(x["anchor"], x["url"]) for x in a], most), texts, lists)

    return F.pandas_udf(run, "string")(text, anchors)
