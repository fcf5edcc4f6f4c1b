"""Chat formatting by quotation linking.

Native: DataFrame functions only. Each line's quote level is its number of leading ``>``; lines of level 0 are a
message's own text. Runs of quoted lines of one level, ended by blank lines, are passages. Passages, and the lines of
passages, are normalised (lower case, white space to single blanks), hashed, and joined to the first message of the
same conversation whose own paragraphs or lines have that hash. The parent of a message is the one that its least
linked level quotes most of, in characters, then the latest. Paths from the root follow by pointer jumping, and
messages come out without quotes, ordered by path: every message after the one it answers, before later threads.

Defined results. Null text: own text null, no quotes. A message that is all quotes has an empty own text. Messages with
a null conv_id or turn are neither linked nor linked to, and their path is empty or their turn alone. Rows that share
(conv_id, turn) share parent and path. Quotes are only linked to earlier turns. An empty table gives an empty result.
Further columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm.shared import cut

MARKS = r"^[ \t]*(?:>[ \t]*)+"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _parsed(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda line: F.struct(_level(line).alias("level"), F.regexp_replace(line, MARKS, "").alias("body")))


def own_text(text: Column) -> Column:
    """The text without quoted lines, trimmed."""
    own = F.filter(_parsed(text), lambda x: x["level"] == 0)
    return F.regexp_replace(F.array_join(F.transform(own, lambda x: x["body"]), "\n"), r"^\s+|\s+$", "")


def units(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, hash, chars): normalised paragraphs and single lines of every level, 0 for own text."""
    messages = messages.select("conv_id", "turn", "text").distinct()  # a repeated row's lines would mix with its copy's
    lines = messages.select("conv_id", "turn", F.xxhash64("text").alias("row"), F.posexplode(_parsed(F.col("text"))).alias("i", "line")).select("conv_id", "turn", "row", "i", "line.*")
    lines = lines.withColumn("blank", ~F.col("body").rlike(r"\S"))
    # a message's lines: the window's groups are no larger than a text
    of_text = Window.partitionBy("conv_id", "turn", "row").orderBy("i")
    breaks = (F.col("level") != F.lag("level", 1, -1).over(of_text)) | F.col("blank")
    runs = lines.withColumn("run", F.sum(breaks.cast("int")).over(of_text)).where("not blank")
    paragraphs = runs.groupBy("conv_id", "turn", "row", "run", "level").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "body"))), lambda x: x["body"]), " ").alias("unit"))
    both = paragraphs.select("conv_id", "turn", "level", "unit").unionByName(runs.select("conv_id", "turn", "level", F.col("body").alias("unit")))
    unit = _normal(F.col("unit"))
    return both.select("conv_id", "turn", "level", F.struct(F.xxhash64(unit).alias("a"), F.xxhash64(F.lit(7919), unit).alias("b")).alias("hash"), F.length(unit).alias("chars")).distinct()


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, level, n_passages, n_linked) of the messages with a linked quote."""
    # only conversations with a quote are taken apart
    quoting = messages.where(F.col("text").rlike(r"(?m)^[ \t]*>") & F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn", "text")
    involved = quoting.select(F.col("conv_id").alias("_conv")).distinct()
    originals = units(messages.select("conv_id", "turn", "text").join(involved, F.col("conv_id") == F.col("_conv"), "left_semi"))
    first = originals.where("level = 0").groupBy(F.col("conv_id").alias("_conv"), F.col("hash").alias("_hash")).agg(F.min("turn").alias("of_turn"))
    quoted = units(quoting).where("level > 0")
    found = quoted.join(first, (F.col("conv_id") == F.col("_conv")) & (F.col("hash") == F.col("_hash")) & (F.col("of_turn") < F.col("turn")))
    by_message = found.groupBy("conv_id", "turn", "level", "of_turn").agg(F.sum("chars").alias("chars"), F.count("*").alias("n"))
    best = F.max_by("of_turn", F.struct(-F.col("level"), "chars", "of_turn"))
    return by_message.groupBy("conv_id", "turn").agg(best.alias("parent_turn"), F.min("level").alias("level"), F.sum("n").alias("n_linked"))


def paths(linked: DataFrame) -> DataFrame:
    """(conv_id, turn, path): turns from the root to each message of links that has a parent."""
    path = cut(linked.select("conv_id", "turn", F.array("parent_turn", "turn").alias("path"), F.col("parent_turn").alias("top")), "chat-paths")
    while True:
        upper = path.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("path").alias("_path"), F.col("top").alias("_top"))
        step = path.join(upper, (F.col("conv_id") == F.col("_conv")) & (F.col("top") == F.col("_turn")), "left")
        longer = F.when(F.col("_path").isNotNull(), F.concat(F.slice("_path", 1, F.size("_path") - 1), "path")).otherwise(F.col("path"))
        path = cut(step.select("conv_id", "turn", longer.alias("path"), F.coalesce("_top", "top").alias("top"), F.col("_path").isNotNull().alias("more")), "chat-paths")
        if path.where("more").limit(1).count() == 0:
            return path.select("conv_id", "turn", "path")


def threaded(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (own), parent_turn, n_linked, depth and path of every row of messages(conv_id, turn, role, text)."""
    messages = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    linked = cut(links(messages), "chat-links")
    found = linked.join(paths(linked), ["conv_id", "turn"]).select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), "parent_turn", "n_linked", "path")
    out = messages.join(cut(found, "chat-found"), (F.col("conv_id") == F.col("_conv")) & (F.col("turn") == F.col("_turn")), "left")
    path = F.coalesce("path", F.when(F.col("turn").isNotNull(), F.array("turn")).otherwise(F.array().cast("array<bigint>")))
    return out.select("conv_id", "turn", "role", own_text(F.col("text")).alias("text"), "parent_turn", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), (F.greatest(F.size(path), F.lit(1)) - 1).cast("long").alias("depth"), path.alias("path"))


def in_reply_order(messages: DataFrame) -> DataFrame:
    """threaded(messages) sorted by conversation and path over all partitions; a long conversation may span several."""
    return threaded(messages).repartitionByRange("conv_id", "path").sortWithinPartitions("conv_id", "path")
