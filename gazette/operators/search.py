"""Many search terms against many texts: postings of three-character grams, intersected and then verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.session import written

#: Characters of a gram, and how many of a term's rarest grams a text must hold before it is looked at.
GRAM, KEYS = 3, 2


def grams(text: Column, n: int = GRAM) -> Column:
    """The distinct substrings of n characters."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(at, lambda i: F.substring(text, i, n)))).otherwise(F.array().cast("array<string>"))


def n_best(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key with their rank. Spark cuts each task's rows to n a key before the shuffle, so a key that holds a third of all rows sends n rows a task."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def occurrences(items: DataFrame, terms: DataFrame) -> DataFrame:
    """(term_id, id): items(id, text) whose text contains a term of terms(term_id, term), in either case. Exact.

    A term of three characters or more is looked up by its two rarest grams; items that have both are candidates, and only
    their texts are searched. A shorter term is a gram of its own length. So work follows postings of rare grams, not terms
    times items. Empty and null terms and null texts match nothing; ids and term_ids are unique, terms may repeat.
    """
    asked = written(terms.select("term_id", F.lower("term").alias("term")).where(F.length("term") > 0), "search-terms")
    words = written(asked.select("term").distinct().withColumn("size", F.least(F.length("term"), F.lit(GRAM))), "search-words")
    texts = written(items.select("id", F.lower("text").alias("text")).where(F.length("text") > 0), "search-texts")
    sizes = sorted(r[0] for r in words.select("size").distinct().collect())  # 1, 2 and 3 at most
    if not sizes:
        return asked.select("term_id").join(texts.select("id"), F.lit(False))
    own = F.when(F.col("size") == GRAM, grams(F.col("term"))).otherwise(F.array("term"))
    wanted = words.select("term", F.explode(own).alias("gram"))
    postings = texts.select("id", F.explode(F.concat(*[grams(F.col("text"), n) for n in sizes])).alias("gram"))
    counts = postings.join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    known = wanted.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = n_best(known, ["term"], [F.asc("n"), F.asc("gram")], KEYS).groupBy("term").agg(F.min("n").alias("least"), F.collect_list("gram").alias("grams"))  # KEYS a term at most
    keys = written(rarest.where("least > 0").select("term", F.explode("grams").alias("gram"), F.size("grams").alias("keys")), "search-keys")
    found = postings.join(keys, "gram").groupBy("term", "id").agg(F.count("*").alias("n"), F.first("keys").alias("keys")).where("n = keys").select("term", "id")
    verified = found.join(texts, "id").where(F.contains("text", "term")).select("term", "id")
    return asked.join(verified, "term").select("term_id", "id")


def search_many(public: DataFrame, queries: DataFrame) -> DataFrame:
    """B3 for many queries(term_id, term) at once: (term_id, id) of the items whose title, organization, post or category contains the text as it is; % and _ are no wildcards."""
    text = F.concat_ws("\n", "title", "organization_name", "post_name", "category_name")
    return occurrences(public.select("id", text.alias("text")), queries)


def name_hubs(public: DataFrame, names: DataFrame) -> DataFrame:
    """B5 for a table of names: per name that occurs in a title or an organization, the number of items in all and by type."""
    text = F.concat_ws("\n", "title", "organization_name")
    hits = occurrences(public.select("id", text.alias("text")), names.select(F.col("name").alias("term_id"), F.col("name").alias("term")).distinct())
    each = hits.join(public.select("id", "type"), "id")
    return each.groupBy(F.col("term_id").alias("name")).agg(F.count("*").alias("total"), *[F.count_if(F.col("type") == t).alias(n) for t, n in (("job", "jobs"), ("result", "results"), ("admit_card", "admit_cards"), ("exam", "exams"))])
