"""Haplotagging: votes of each alignment for the two haplotypes of its phase sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def phasing_quality(h1: Column, h2: Column) -> Column:
    """0 without votes, 40 if they agree, else -10 log10 of the minority's share, cut to an integer."""
    most, least = F.greatest(h1, h2), F.least(h1, h2)
    return F.when(most == 0, 0).when(least == 0, 40).otherwise(F.floor(F.round(-10 * F.log10(F.try_divide(least.cast("double"), most + least)), 9))).cast("int")


def votes(obs: DataFrame, phased: DataFrame, keys: tuple[str, ...] = ("chrom", "read_id")) -> DataFrame:
    """(keys, h1, h2, n_ps, ps, total). phased: (chrom, pos, hp, ps), hp the haplotype of the reference allele."""
    x = obs.join(phased.select("chrom", "pos", "hp", "ps"), ["chrom", "pos"])
    hap = F.when(F.col("allele") == 0, F.col("hp")).otherwise(3 - F.col("hp"))
    return x.groupBy(*keys).agg(F.count_if(hap == 1).alias("h1"), F.count_if(hap == 2).alias("h2"), F.count_distinct("ps").alias("n_ps"), F.min("ps").alias("ps"), F.count("*").alias("total"))


def with_extra(v: DataFrame, extra: DataFrame, key: str = "read_id") -> DataFrame:
    """Adds each read's votes from structural variants or modifications. extra: (key, h1, h2)."""
    e = extra.groupBy(key).agg(F.sum("h1").alias("_1"), F.sum("h2").alias("_2"))
    return v.join(e, key, "left").withColumn("h1", F.col("h1") + F.coalesce("_1", F.lit(0))).withColumn("h2", F.col("h2") + F.coalesce("_2", F.lit(0))).drop("_1", "_2")


def judged(v: DataFrame, percentage: float = 0.6) -> DataFrame:
    """Adds pq and hp (0: untagged): enough of the votes agree and all are of one phase set."""
    most, least = F.greatest("h1", "h2"), F.least("h1", "h2")
    clear = F.coalesce(F.try_divide(most.cast("double"), most + least) >= percentage, F.lit(False))
    hp = F.when(~clear | (F.col("n_ps") > 1), 0).when(F.col("h1") > F.col("h2"), 1).when(F.col("h1") < F.col("h2"), 2).otherwise(0)
    return v.withColumn("hp", hp).withColumn("pq", F.when(clear, phasing_quality(F.col("h1"), F.col("h2"))).otherwise(F.when(F.greatest("h1", "h2") == 0, 0).otherwise(phasing_quality(F.col("h1"), F.col("h2")))))


def sv_votes(ops: DataFrame, svs: DataFrame, threshold: float = 0.10) -> DataFrame:
    """(read_id, h1, h2) from operations (read_id, ref_pos, op, len), each compared with the next SV at or after it. svs: (chrom, pos, svlen, sv_hp)."""
    from strandloom.operators.cigar import sv_similar
    from strandloom.operators.ranges import asof_forward

    x = asof_forward(ops, svs.select("chrom", F.col("pos").alias("sv_pos")), ["chrom"], "ref_pos", "sv_pos")
    x = x.join(svs.select("chrom", F.col("pos").alias("sv_pos"), "svlen", "sv_hp"), ["chrom", "sv_pos"])
    hit = F.col("op").isin("I", "D") & (sv_similar(F.col("svlen"), F.col("len")) < threshold)
    return x.where(hit).groupBy("read_id").agg(F.count_if(F.col("sv_hp") == 1).alias("h1"), F.count_if(F.col("sv_hp") == 2).alias("h2"))


def counters(routed: DataFrame) -> DataFrame:
    """Run totals over (route, hp)."""
    n = lambda c: F.count_if(c)
    tagged = (F.col("route") == "judge") & (F.col("hp") > 0)
    return routed.agg(F.count("*").alias("total"), n(F.col("route") == "supplementary").alias("supplementary"), n(F.col("route") == "secondary").alias("secondary"), n(F.col("route") == "unmapped").alias("unmapped"), n(tagged).alias("tagged"), n(~tagged).alias("untagged"))


def log_rows(j: DataFrame) -> DataFrame:
    """The read report's columns of judged alignments (chrom, read_name, start, h1, h2, hp, ps, pq, total)."""
    name = F.when(F.col("hp") == 0, ".").otherwise(F.col("hp").cast("string"))
    share = F.try_divide(F.greatest("h1", "h2").cast("double"), F.col("h1") + F.col("h2"))
    return j.select(
        F.col("read_name").alias("Read"), F.col("chrom").alias("Chr"), F.col("start").alias("ReadStart"), share.alias("Confidnet(%)"), name.alias("Haplotype"),
        F.when(F.col("hp") == 0, ".").otherwise(F.col("ps").cast("string")).alias("PhaseSet"), F.col("total").alias("TotalAllele"), F.col("h1").alias("HP1Allele"), F.col("h2").alias("HP2Allele"), F.col("pq").alias("phasingQuality(PQ)"),
    )
