"""Depth by a sweep over starts and ends, and pileup columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def depth_sweep(aln: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, pos, depth) where the depth changes: end is exclusive. Deltas are summed by position before the running sum."""
    d = aln.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("pos"), F.lit(1).alias("d")), F.struct(F.col(end).alias("pos"), F.lit(-1).alias("d")))).alias("x")).select(*keys, "x.pos", "x.d")
    d = d.groupBy(*keys, "pos").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("depth", F.sum("d").over(w)).drop("d")


def pileup_depth(blocks: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Depth at every covered position (end inclusive). The sweep is expanded, so a deep column costs one row."""
    s = depth_sweep(blocks.withColumn("_e", F.col(end) + 1), keys, start, "_e")
    w = Window.partitionBy(*keys).orderBy("pos")
    s = s.withColumn("_next", F.lead("pos").over(w)).where("depth > 0")
    return s.select(*keys, F.explode(F.sequence("pos", F.col("_next") - 1)).alias("pos"), "depth")


def pileup_columns(ops: DataFrame, keys: list[str]) -> DataFrame:
    """One row a read and covered position. ops: CIGAR blocks as made by cigar.blocks (ref_start, op, len, query_start, next_op, next_len, first, last)."""
    x = ops.where(F.col("op").isin("M", "=", "X", "D", "N"))
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1)).alias("k")
    x = x.select("*", k)
    last = F.col("k") == F.col("len") - 1
    indel = F.when(last & (F.col("next_op") == "I"), F.col("next_len")).when(last & (F.col("next_op") == "D"), -F.col("next_len")).otherwise(0)
    match = F.col("op").isin("M", "=", "X")
    return x.select(
        *keys, (F.col("ref_start") + F.col("k")).alias("pos"), F.when(match, F.col("query_start") + F.col("k")).otherwise(F.col("query_start")).alias("qpos"), indel.cast("long").alias("indel"),
        (F.col("op") == "D").alias("is_del"), (F.col("op") == "N").alias("is_refskip"), (F.col("first") & (F.col("k") == 0)).alias("is_head"), (F.col("last") & last).alias("is_tail"),
    )


def capped(columns: DataFrame, keys: list[str], order: list[str], cap: int = 8000) -> DataFrame:
    """The first reads of each column up to a depth."""
    w = Window.partitionBy(*keys, "pos").orderBy(*order)
    return columns.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")
