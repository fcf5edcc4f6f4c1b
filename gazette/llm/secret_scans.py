"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content. The ledger holds, per blob, rule and rule
version, the spans found. A scan takes the blobs that lack a current (rule, version) pair, scans one copy of each for
the missing rules only, and appends to the ledger, a folder that outlives the run if the caller names one; findings of
the current versions are then joined back to all paths by address.

Defined results. Null text: scanned as empty. Repeated rows and copies: one blob, one finding set, every row gets it.
Null ids are joined as values. Spans are code points, end exclusive. An empty table gives an empty ledger and result.
Further columns don't matter, and masked carries them. Without a ledger's name each call has a ledger of its own.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.shared import shared_dir


@dataclass(frozen=True)
class Rule:
    """A kind of secret. group and least: that group of a match must have so many characters, else the match is dropped."""

    kind: str
    version: int
    pattern: str
    least: int = 0
    group: int = 0
    flags: int = 0


_BREAK = r"(?:\s|\\[rnt])*+"
_LINE_END = r"(?=[\x20\t]*(?:[\r\n]|\\[rn]|\Z))"
#: From BEGIN to the END line of the same label; where that is missing, over the header lines and the run of base64 lines
#: that follow. Line breaks may be escaped, as in JSON. A key has no run of five hyphens, so no match reaches into another.
PRIVATE_KEY = (
    r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?)-----"
    r"(?:(?:[^-]|-(?!----))*+-----END \1-----"
    rf"|(?:(?:{_BREAK}(?:(?:Proc-Type|DEK-Info|Version|Comment|Hash):[^\r\n\\]*+|[A-Za-z0-9+/]{{40,}}+={{0,2}}|[A-Za-z0-9+/]{{16,}}+={{0,2}}{_LINE_END}))++(?:{_BREAK}[A-Za-z0-9+/]++={{0,2}}{_LINE_END})?)?)"
)
#: In this order spans with the same start are listed. The first three are the base rules.
RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, re.IGNORECASE | re.ASCII),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 16),
    Rule("hex", 1, r"[0-9a-f]+", 32),
    Rule("private_key", 2, PRIVATE_KEY),
    Rule("hosted_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
BASE = ("assign", "access", "hex")


def found(text: str, rule: Rule) -> list[tuple[int, int]]:
    """Spans of the leftmost non-overlapping matches that are long enough."""
    pattern = rule.pattern
    if rule.kind == "hex":  # a run is matched whole, so short runs can be passed over within the search
        pattern = f"[0-9a-f]{{{rule.least},}}"
    return [m.span() for m in re.finditer(pattern, text, rule.flags) if len(m.group(rule.group)) >= rule.least]


def addressed(docs: DataFrame, path: str = "doc_id") -> DataFrame:
    """(path, blob): the content address of every row."""
    return docs.select(F.col(path).alias("path"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("blob"))


LEDGER = "blob binary, findings array<struct<rule:string,starts:array<bigint>,ends:array<bigint>>>"


def _scanner(rules: tuple[Rule, ...]):
    by_name = {f"{r.kind}@{r.version}": r for r in rules}

    @F.pandas_udf(LEDGER.removeprefix("blob binary, findings "))
    def scan(texts: pd.Series, missing: pd.Series) -> pd.Series:
        out = []
        for text, names in zip(texts, missing, strict=True):
            spans = {n: found(text or "", by_name[n]) for n in names}
            out.append([{"rule": n, "starts": [s for s, _ in v], "ends": [e for _, e in v]} for n, v in spans.items()])
        return pd.Series(out)

    return scan


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path: str = "doc_id") -> DataFrame:
    """New ledger rows (blob, findings: array of (rule, starts, ends)) for the pairs that the ledger lacks.

    One copy of each blob is scanned: the one with the least path.
    """
    names = F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules])
    copies = addressed(docs, path).groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is None:
        due = copies.withColumn("missing", names)
    else:
        # a ledger holds a few rows a blob at most: one for each time that rules changed, or that portions were scanned at once
        seen = ledger.select("blob", F.explode("findings.rule").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        due = copies.join(seen, "blob", "left").select("blob", "path", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>"))).alias("missing")).where("size(missing) > 0")
    due = due.select(F.col("path").alias("due_path"), F.col("blob").alias("due_blob"), "missing")
    texts = docs.select(F.col(path).alias("path"), F.coalesce("text", F.lit("")).alias("text")).withColumn("own_blob", F.unhex(F.sha2("text", 256)))
    one = texts.join(due, F.col("path").eqNullSafe(F.col("due_path")) & (F.col("own_blob") == F.col("due_blob")))
    return one.select(F.col("due_blob").alias("blob"), _scanner(rules)("text", "missing").alias("findings"))


def updated(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", increments: int = 1) -> DataFrame:
    """The ledger in that folder, after a scan of what it lacks of docs.

    increments: the rows come in so many portions by hash of their path; a blob that an earlier one held isn't scanned again.
    """
    spark = docs.sparkSession
    ledger = ledger or f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}"
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger)  # from now on there is one
    for k in range(increments):
        portion = docs.where(F.pmod(F.xxhash64(path), F.lit(increments)) == k) if increments > 1 else docs
        one_row_a_blob(scan_unseen(portion, spark.read.schema(LEDGER).parquet(ledger), rules, path)).write.mode("append").parquet(ledger)
    return spark.read.schema(LEDGER).parquet(ledger)


def findings_of(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, findings) of the blobs in which the current versions of the rules found anything, a row a blob."""
    found = F.filter("findings", lambda f: (F.size(f["starts"]) > 0) & f["rule"].isin([f"{r.kind}@{r.version}" for r in rules]))
    rows = ledger.select("blob", found.alias("findings")).where("size(findings) > 0")
    return rows.groupBy("blob").agg(F.flatten(F.collect_list("findings")).alias("findings"))


def report(docs: DataFrame, ledger: DataFrame, path: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, findings) of every row of docs: the ledger's findings joined back to all paths."""
    return addressed(docs, path).join(findings_of(ledger, rules), "blob", "left").select("path", "blob", "findings")


def _digest(kinds: tuple[str, ...]):
    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def digest(findings: pd.Series) -> pd.DataFrame:
        rows = []
        for items in findings:
            spans = sorted((s, kinds.index(k), e) for f in (items if items is not None else ()) for k in [f["rule"].split("@")[0]] for s, e in zip(f["starts"], f["ends"], strict=True))
            base = [x for x in spans if kinds[x[1]] in BASE]
            text = [",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in group) for group in (base, spans)]
            counts = [sum(kinds[x[1]] == k for x in base) for k in BASE]
            rows.append((*counts, hashlib.sha256(text[0].encode()).hexdigest(), text[1]))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return digest


def summary(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: str | None = None, increments: int = 1) -> DataFrame:
    """doc_id, counts of the base kinds, a hash of the base spans, and all spans, for every row of docs."""
    out = report(docs, updated(docs, ledger, rules, increments=increments), rules=rules).select(F.col("path").alias("doc_id"), _digest(tuple(r.kind for r in rules))("findings").alias("d"))
    return out.select("doc_id", "d.*")


def one_row_a_blob(ledger: DataFrame) -> DataFrame:
    """Repeated rows of docs have the same path and blob and are scanned more than once; their findings are equal."""
    return ledger.dropDuplicates(["blob"])


def _masked(texts: pd.Series, findings: pd.Series) -> pd.Series:
    out = []
    for text, items in zip(texts, findings, strict=True):
        if items is None or text is None:
            out.append(text)
            continue
        parts, end = [], 0
        for s, e in sorted((int(s), int(e)) for f in items for s, e in zip(f["starts"], f["ends"], strict=True)):
            if s >= end:
                parts += [text[end:s], "[secret]"]
            end = max(end, e)
        out.append("".join([*parts, text[end:]]))
    return pd.Series(out)


def masked(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: str | None = None) -> DataFrame:
    """docs with every span, overlapping ones as one, replaced by ``[secret]``; other texts and columns stay as they are."""
    rows = findings_of(updated(docs, ledger, rules), rules).select(F.col("blob").alias("_blob"), F.col("findings").alias("_findings"))
    keyed = docs.withColumn("_key", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    joined = keyed.join(rows.hint("merge"), F.col("_key") == F.col("_blob"), "left")
    return joined.withColumn("text", F.pandas_udf(_masked, "string")("text", "_findings")).select(*docs.columns)
