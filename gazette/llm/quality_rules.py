"""Quality rules: thresholds per language and source from mergeable quantile sketches.

Each document gets a few counts (one Arrow-batched pass), from which integer measures follow. A measure's
distribution is kept as a log-linear histogram: values under 64 exactly, above that the six leading bits. Such
sketches merge by adding counts, so sources merge into languages and languages into the corpus, and the result
doesn't depend on the order of tasks. Thresholds read from the sketches are joined back to the documents by
(language, source).

Measures that most texts don't have at all (symbols, repeated lines) are cut where the language's own sketch breaks: the
widest gap between filled bins from the median on, in proportion, if values above it are ``RATIO`` times those below. A bin
with less than a ``RARE``-th of the documents doesn't fill a gap. A group's limit lies midway between its own last bin up to the
language's break and its own first bin from its end on, both weighted with the language's. Without a break nothing is junk by
that measure, and there is no limit. Languages under ``MIN_DOCS`` documents go by the corpus's break.

The limits of the other measures start at the median and reach out by a multiple of a spread: for word lengths the distance
to the nearer quartile, so junk on one side of up to nearly half of a group moves it little; for repeated words, the distance to
the ninth decile. Medians and spreads are weighted means of the group's, its language's and the corpus's, by documents. No group
reaches out further than half as far again as its language's middle source does, each source having one vote: a dirty
source can't lift its own limit, however large it is. A spread has a floor, for groups whose values are all but equal.

Defined results. Null or empty text: no words, so the base rule fails and the row is not kept. Null language or
source: a group of its own. Repeated rows: each is judged and counted. A language counts like ``MIN_DOCS`` further
documents in its groups, and the corpus like as many in its languages. An empty table gives an empty result. Further columns of
the input aren't carried by judge; names that clash with the result's don't matter.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm.shared import cut, cuts, remove

@dataclass(frozen=True)
class Measure:
    """side: whether values above or below the limit fail. fence: spreads from the median to the limit, or 0 for a limit at the break. floor: the least spread. tenths: the decile of the spread, or 0 for the nearer quartile. unit: what is added to the values at either side of a break, as shares near 0 have no proportion: about what one occurrence makes in a short text."""

    side: str
    fence: int = 0
    floor: int = 0
    tenths: int = 0
    unit: int = 0


#: The measures are integers: millionths of characters, lines and words, and thousandths of characters a word.
MEASURES = {
    "symbol_ppm": Measure("high", unit=10_000),
    "dup_line_ppm": Measure("high", unit=100_000),
    "repeat_ppm": Measure("high", 12, 10_000, 9),
    "long_word_milli": Measure("high", 16, 150),
    "short_word_milli": Measure("low", 16, 150),
}
#: A language counts like so many further documents in its groups, and the corpus in its languages. A limit's greatest distance from the median, in hundredths of that in its language's middle source.
MIN_DOCS, MOST = 50, 150
#: A break's values above over those below, each with the measure's unit; the part of documents that fills a bin.
RATIO, RARE = 4, 1000

_COUNTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def count_text(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The counts of one text. Words are separated by ASCII white space, which bytes.split() does."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return (0, 0, 0, 0, 0, 0)
    blanks = len(raw) - sum(map(len, words))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) < len(windows):
        often = {w for w, n in Counter(windows).items() if n > 1}
        end = 0
        for i, window in enumerate(windows):
            if window in often:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return (len(words), len(text) - blanks, symbols, len(lines), len(lines) - len(set(lines)), repeated)


def _count(texts: pa.Array) -> pa.Array:
    """Text by text, so that a batch isn't held a second time as Python strings."""
    counts = np.array([count_text(t.as_py()) for t in texts], np.int64).reshape(-1, 6)
    return pa.StructArray.from_arrays([pa.array(c) for c in counts.T], names=[c.split()[0] for c in _COUNTS.split(", ")])


def measured(docs: DataFrame, *carried: str) -> DataFrame:
    """The carried columns, the base counts and the measures of every document.

    The function is declared nondeterministic, else a filter on its results would have Spark run it twice.
    """
    out = docs.select(*carried, F.arrow_udf(_count, _COUNTS).asNondeterministic()("text").alias("_c")).select(*carried, "_c.*")

    def per(top: str, bottom: str, scale: int) -> Column:
        return F.expr(f"({top} * {scale}) div greatest({bottom}, 1)")

    return out.withColumns(
        {
            "symbol_ppm": per("n_symbols", "word_chars", 1_000_000),
            "dup_line_ppm": per("n_dup_lines", "n_lines", 1_000_000),
            "repeat_ppm": per("n_repeat_words", "n_words", 1_000_000),
            "long_word_milli": per("word_chars", "n_words", 1_000),
            "short_word_milli": per("word_chars", "n_words", 1_000),
            "base_failed": F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"),
        }
    )


def bin_of(value: str) -> Column:
    """The lower end of the value's bin."""
    return F.expr(f"case when {value} < 64 then {value} else shiftleft(shiftright({value}, length(bin({value})) - 6), length(bin({value})) - 6) end")


def sketches(measures: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, n) of the documents that pass the base rule."""
    stacked = ", ".join(f"'{m}', {m}" for m in MEASURES)
    long = measures.where("not base_failed").selectExpr("lang", "source", f"stack({len(MEASURES)}, {stacked}) as (measure, value)")
    return long.groupBy("lang", "source", "measure", bin_of("value").alias("bin")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    return sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """(keys, measure, n, q1, q2, q3, d9): the bins that hold the ranks ceil(n/4), ceil(n/2), ceil(3n/4) and ceil(9n/10)."""
    whole = Window.partitionBy(*keys, "measure")
    ranked = sketch.withColumns({"upto": F.sum("n").over(whole.orderBy("bin")), "total": F.sum("n").over(whole)})
    parts = {"q1": (1, 4), "q2": (1, 2), "q3": (3, 4), "d9": (9, 10)}
    return ranked.groupBy(*keys, "measure").agg(F.max("total").alias("n"), *[F.min(F.expr(f"case when {of} * upto >= {part} * total then bin end")).alias(q) for q, (part, of) in parts.items()])


def breaks(sketch: DataFrame, *keys: str) -> DataFrame:
    """(keys, measure, n, low, high): the bins at either side of the widest break from the median on, null where there is none."""
    whole = Window.partitionBy(*keys, "measure")
    ranked = sketch.withColumns({"upto": F.sum("n").over(whole.orderBy("bin")), "total": F.sum("n").over(whole)})
    filled = ranked.where(F.expr(f"n * {RARE} >= total")).withColumn("next", F.lead("bin").over(whole.orderBy("bin")))
    unit = "case " + " ".join(f"when measure = '{m}' then {x.unit}" for m, x in MEASURES.items() if x.unit) + " end"
    filled = filled.withColumn("unit", F.expr(unit))
    wide = F.expr(f"case when 2 * upto >= total and next + unit >= {RATIO} * (bin + unit) then (next + unit) * 1000 div (bin + unit) end")
    widest = F.max_by(F.struct("bin", "next"), F.when(wide.isNotNull(), F.struct(wide.alias("wide"), (-F.col("bin")).alias("at"))))
    return filled.groupBy(*keys, "measure").agg(F.max("total").alias("n"), widest.alias("b")).select(*keys, "measure", "n", F.col("b.bin").alias("low"), F.col("b.next").alias("high"))


def at_breaks(sketch: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, measure, limit) between what lies below and above the language's break in each group."""
    of_lang = breaks(merged(sketch, "lang"), "lang").select(F.col("lang").alias("l_lang"), F.col("measure").alias("l_measure"), F.col("n").alias("l_n"), F.col("low").alias("l_low"), F.col("high").alias("l_high"))
    of_all = breaks(merged(sketch)).select(F.col("measure").alias("a_measure"), F.col("low").alias("a_low"), F.col("high").alias("a_high"))
    rows = sketch.join(of_lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("measure") == F.col("l_measure"))).join(of_all, F.col("measure") == F.col("a_measure"))
    small = F.col("l_n") < min_docs
    rows = rows.withColumns({"low": F.when(small, F.col("a_low")).otherwise(F.col("l_low")), "high": F.when(small, F.col("a_high")).otherwise(F.col("l_high"))}).where("high is not null")
    own = rows.groupBy("lang", "source", "measure", "low", "high").agg(F.sum("n").alias("n"), F.max(F.expr("case when bin <= low then bin end")).alias("below"), F.min(F.expr("case when bin >= high then bin end")).alias("above"))
    mean = lambda value, level: f"((n * coalesce({value}, {level}) + {min_docs} * {level}) div (n + {min_docs}))"
    return own.select("lang", "source", "measure", F.expr(f"({mean('below', 'low')} + {mean('above', 'high')}) div 2").alias("limit"))


def by_spread(sketch: DataFrame, measures: dict[str, Measure], min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, measure, limit) by medians and spreads."""

    def level(part: DataFrame, keys: tuple[str, ...], prefix: str) -> DataFrame:
        spread = "case " + " ".join(f"when measure = '{m}' then " + (f"d{x.tenths} - q2" if x.tenths else "least(q2 - q1, q3 - q2)") for m, x in measures.items()) + " end"
        return quantiles(part, *keys).select(*[F.col(k).alias(prefix + k) for k in (*keys, "measure", "n")], F.col("q2").alias(prefix + "mid"), F.expr(spread).alias(prefix + "spread"))

    def mean(value: str, n: str, of_more: str) -> str:
        return f"(({n} * {value} + {min_docs} * {of_more}) div ({n} + {min_docs}))"

    same_lang = F.col("lang").eqNullSafe(F.col("l_lang"))
    own = level(sketch, ("lang", "source"), "").join(level(merged(sketch, "lang"), ("lang",), "l_"), same_lang & (F.col("measure") == F.col("l_measure"))).join(level(merged(sketch), (), "a_"), F.col("measure") == F.col("a_measure"))
    chosen = own.select("lang", "source", "measure", *[F.expr(mean(x, "n", mean(f"l_{x}", "l_n", f"a_{x}"))).alias(x) for x in ("mid", "spread")])
    reach = "case " + " ".join(f"when measure = '{m}' then {x.fence} * greatest({x.floor}, spread)" for m, x in measures.items()) + " end"
    chosen = cut(chosen.withColumn("reach", F.expr(reach)), "quality-groups")
    votes = chosen.groupBy("lang", "measure", bin_of("reach").alias("bin")).agg(F.count("*").alias("n"))
    middle = quantiles(votes, "lang").select(F.col("lang").alias("l_lang"), F.col("measure").alias("l_measure"), F.col("q2").alias("l_reach"))
    chosen = chosen.join(middle, same_lang & (F.col("measure") == F.col("l_measure"))).withColumn("reach", F.expr(f"least(reach, {MOST} * l_reach div 100)"))
    low = F.col("measure").isin([m for m, x in measures.items() if x.side == "low"])
    return chosen.select("lang", "source", "measure", (F.col("mid") + F.when(low, -F.col("reach")).otherwise(F.col("reach"))).alias("limit"))


def thresholds(sketch: DataFrame, measures: dict[str, Measure] = MEASURES, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per (lang, source) with a limit for each measure, null where there is none."""
    spread = {m: x for m, x in measures.items() if x.fence}
    at_break = F.col("measure").isin([m for m in measures if m not in spread])
    rows = by_spread(sketch.where(~at_break), spread, min_docs).unionByName(at_breaks(sketch.where(at_break), min_docs))
    return rows.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m, F.col("limit"))).alias(f"limit_{m}") for m in measures])


def verdicts(measures: DataFrame, limits: DataFrame) -> DataFrame:
    """measures with the limits of its language and source, and kept. The join is on equal keys, nulls included."""
    limits = limits.selectExpr("lang as t_lang", "source as t_source", *[f"limit_{m}" for m in MEASURES])
    joined = measures.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    fails = " or ".join(f"coalesce({m} {'>' if x.side == 'high' else '<'} limit_{m}, false)" for m, x in MEASURES.items())
    return joined.drop("t_lang", "t_source").withColumn("kept", F.expr(f"not (base_failed or {fails})"))


def limits_of(measures: DataFrame) -> DataFrame:
    """thresholds() of measured documents as a table; the sketches that it was made from are removed."""
    spark = measures.sparkSession
    outside = cuts(spark)
    limits = cut(thresholds(cut(sketches(measures), "quality-sketches")), "quality-limits")
    remove(spark, [p for p in cuts(spark)[:-1] if p not in outside])
    return limits


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, counts, base_failed, measures, limits and kept for every row of docs(doc_id, text, lang, source)."""
    measures = cut(measured(docs, "doc_id", "lang", "source"), "quality-measures")
    return verdicts(measures, limits_of(measures))


def filtered(docs: DataFrame) -> DataFrame:
    """The kept rows of docs, with all their columns. Texts are counted once and written with their measures."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select("text", "lang", "source", F.struct(*others).alias("_row"))
    measures = cut(measured(rows, "text", "lang", "source", "_row"), "quality-measures")
    kept = verdicts(measures, limits_of(measures)).where("kept")
    return kept.select(*[F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])
