"""Quotation linking and reply-ordered conversations, in DataFrame functions alone.

A line's quote level is the number of ``>`` that it begins with. Consecutive quoted lines of one level are a passage; what
remains, without the attribution line before a quote, is the message's own text. Passages, their paragraphs (cut at
empty quoted lines) and single lines are normalised and hashed, and so are each message's own text, its paragraphs and lines. A quote
is linked to the latest earlier message of its conversation that holds its hash: both sides are put
in order and the last original carried forward, so a passage that recurs many times costs one row each, never pairs.
A quote not found there, of ``LEAST_CHARS`` normalised characters or more, is linked to the first message anywhere that holds it. The parent of a message is the one
from which it quotes most at level 1. Paths from the first message are built by pointer doubling, in as many
rounds as the logarithm of the deepest thread.

Defined results: a null or empty text has no lines and no own text; rows with the same conversation and turn get the same
links; rows without conversation or turn are linked with nothing; a quote of nothing known
has no link and is still removed; an empty table gives no rows; clashing extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm._store import stored

LEAST_CHARS = 12
ATTRIBUTION = r"^\s*(On\b.*\bwrote|Am\b.*\bschrieb.*|Le\b.*\ba écrit|El\b.*\bescribió|-+ ?Original Message ?-+)\s*:?\s*$"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def lines(text: Column) -> Column:
    """Array of (level, text) of the lines of a message."""
    mark = r"^\s*(?:>\s?)+"
    cut = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n", -1)
    return F.transform(cut, lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, mark, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, mark, "").alias("text")))


def passages(ls: Column) -> Column:
    """Runs of lines of one level: array of (level, lines)."""
    one = "struct<level:int,lines:array<string>>"
    zero = F.array().cast(f"array<{one}>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        new = F.struct(x["level"].alias("level"), F.array(x["text"]).alias("lines"))
        more = F.struct(x["level"].alias("level"), F.array_append(last["lines"], x["text"]).alias("lines"))
        same = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["level"] == x["level"])
        return F.when(same, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(more))).otherwise(F.array_append(acc, new))

    return F.aggregate(ls, zero, step)


def parsed(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, clean_text, n_quoted_lines, max_level, quotes (level, chars, hash), own (chars, hash)."""
    out = messages.select(F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), F.col(f"`{role}`").cast("string").alias("role"), F.col(f"`{text}`").cast("string").alias("_text"))
    out = out.withColumn("_quoting", F.coalesce(F.col("_text"), F.lit("")).rlike(r"(?m)^\s*>"))
    out = out.withColumn("_lines", F.when(F.col("_quoting"), lines(F.col("_text"))))
    level = lambda x: x["level"]
    plain = F.filter("_lines", lambda x, k: (level(x) == 0) & ~(x["text"].rlike(ATTRIBUTION) & (F.coalesce(F.try_element_at(F.col("_lines"), k + 2)["level"], F.lit(0)) > 0)))
    clean = F.trim(F.regexp_replace(F.array_join(F.transform(plain, lambda x: x["text"]), "\n"), r"\n{3,}", "\n\n"))
    out = out.withColumn("clean_text", F.when(F.col("_quoting"), clean).otherwise(F.coalesce(F.col("_text"), F.lit(""))))
    runs = F.filter(passages(F.col("_lines")), lambda r: level(r) > 0)
    units = lambda r: F.array_distinct(F.concat(F.array(F.array_join(r["lines"], " ")), F.split(F.array_join(r["lines"], "\n"), r"\n\s*\n"), r["lines"]))
    hashed = lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(x, F.lit(1)).alias("h2"))
    quotes = F.flatten(F.transform(runs, lambda r: F.transform(F.filter(F.transform(units(r), normalised), lambda x: F.length(x) > 0), lambda x: F.struct(level(r).alias("level"), F.length(x).alias("chars"), hashed(x).alias("hash")))))
    parts = F.concat(F.array(F.col("clean_text")), F.split("clean_text", r"\n\s*\n"), F.split("clean_text", "\n"))
    own = F.transform(F.filter(F.array_distinct(F.transform(parts, normalised)), lambda x: F.length(x) > 0), lambda x: F.struct(F.length(x).alias("chars"), hashed(x).alias("hash")))
    none = F.array().cast("array<struct<level:int,chars:int,hash:struct<h1:bigint,h2:bigint>>>")
    return out.select(
        "conv_id", "turn", "role", "clean_text", F.coalesce(F.size(F.filter("_lines", lambda x: level(x) > 0)), F.lit(0)).alias("_n"),
        F.when(F.col("_quoting"), F.array_max(F.transform("_lines", level))).otherwise(0).alias("max_level"),
        F.when(F.col("_quoting"), quotes).otherwise(none).alias("quotes"), own.alias("own"),
    ).withColumn("n_quoted_lines", F.greatest("_n", F.lit(0))).drop("_n")


def linked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn, n_links, source_conv_id, source_turn (of a quote found elsewhere only)."""
    q = rows.where("size(quotes) > 0 and conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(F.array_distinct("quotes")).alias("q"))
    q = stored(q.select("conv_id", "turn", "q.level", "q.chars", "q.hash").distinct(), "quotes")
    own = rows.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("own").alias("o")).select("conv_id", "turn", "o.chars", "o.hash")
    long_ = F.col("chars") >= LEAST_CHARS
    afar = own.where(long_).join(q.where(long_).select("hash").distinct(), "hash", "left_semi").select("conv_id", "turn", "chars", "hash")
    near = own.where(~long_).join(q.where(~long_).select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi").select("conv_id", "turn", "chars", "hash")
    own = stored(afar.unionByName(near).distinct(), "originals")
    both = own.select("conv_id", "hash", "turn", F.col("turn").alias("orig"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("chars")).unionByName(q.withColumn("orig", F.lit(None).cast("long")))
    before = Window.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("from", F.last("orig", ignorenulls=True).over(before)).where("level is not null")
    anywhere = own.where(long_).groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    found = found.where(long_).join(anywhere, "hash", "left").unionByName(found.where(~long_), allowMissingColumns=True)
    vote = found.groupBy("conv_id", "turn", "from").agg(F.sum(F.when(F.col("level") == 1, F.col("chars")).otherwise(0)).alias("chars"), F.count("*").alias("n"), F.min(F.when(F.col("from").isNull() & ((F.col("first.conv_id") != F.col("conv_id")) | (F.col("first.turn") < F.col("turn"))), F.col("first"))).alias("other"))
    best = F.max_by("from", F.when(F.col("from").isNotNull() & (F.col("chars") > 0), F.struct("chars", "from")))
    n = F.sum(F.when(F.col("from").isNotNull() | F.col("other").isNotNull(), F.col("n")).otherwise(0))
    return vote.groupBy("conv_id", "turn").agg(best.alias("parent_turn"), n.alias("n_links"), F.min("other").alias("o")).select("conv_id", "turn", "parent_turn", "n_links", F.col("o.conv_id").alias("source_conv_id"), F.col("o.turn").alias("source_turn"))


def paths(links: DataFrame) -> DataFrame:
    """conv_id, turn, path: turns from the first message of the thread to this one, for messages with a parent."""
    now = stored(links.where("parent_turn is not null").select("conv_id", "turn", F.col("parent_turn").alias("up"), F.array("turn").alias("path")), "paths")
    while True:
        above = now.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("up").alias("up2"), F.col("path").alias("path2"))
        step = now.join(above, (now["conv_id"] == above["c"]) & (now["up"] == above["t"]), "left")
        now = stored(step.select("conv_id", "turn", F.coalesce("up2", "up").alias("up"), F.when(F.col("t").isNotNull(), F.concat("path2", "path")).otherwise(F.col("path")).alias("path"), F.col("t").isNotNull().alias("moved")), "paths")
        if not now.where("moved").limit(1).count():
            return now.select("conv_id", "turn", F.concat(F.array("up"), "path").alias("path"))
        now = now.drop("moved")


def conversations(messages: DataFrame, **names: str) -> DataFrame:
    """Messages without quotes, ordered by conversation and reply path (a range shuffle: no task holds a conversation)."""
    rows = parsed(messages, **names)
    links = stored(linked(rows), "links")
    way = paths(links)
    out = rows.drop("quotes", "own").join(links, ["conv_id", "turn"], "left").join(way, ["conv_id", "turn"], "left")
    out = out.withColumn("path", F.coalesce("path", F.array("turn")))
    out = out.select("conv_id", "turn", "role", "clean_text", "n_quoted_lines", "max_level", F.coalesce("n_links", F.lit(0)).alias("n_links"), "parent_turn", F.element_at("path", 1).alias("root_turn"), (F.size("path") - 1).alias("depth"), "path", "source_conv_id", "source_turn")
    return out.repartitionByRange("conv_id", "path").sortWithinPartitions("conv_id", "path")


def query(spark, sf_dir: str) -> DataFrame:
    out = conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.withColumn("path", F.array_join("path", "/", "?"))
