"""Correction of phased positions by the reads: reads vote for a haplotype, then haplotypes vote for each position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.params import MOD, SNP, SV

#: obs of a read on the assigned haplotypes
HAP = "CASE WHEN allele = 0 THEN hp ELSE 3 - hp END"


def _sums() -> dict[str, Column]:
    """What an observation with ``hap`` and ``vtype`` adds to its read's votes. Modifications don't vote."""
    high = F.col("vtype").isin(SNP, SV)
    return {f"h{h}_{k}": F.when((F.col("vtype") != MOD) & (F.col("hap") == h) & (high if k == "hi" else ~high), 1).otherwise(0) for h in (1, 2) for k in ("hi", "lo")}


def _with_verdict(v: DataFrame, confidence: float, low: float) -> DataFrame:
    """Adds the haplotype that the votes name, and whether it is confident."""
    h1, h2 = (F.round(F.col(f"h{h}_hi") + F.lit(low) * F.col(f"h{h}_lo"), 6) for h in (1, 2))
    v = v.withColumn("_1", h1).withColumn("_2", h2)
    most = F.greatest("_1", "_2")
    sure = F.coalesce(F.try_divide(most, F.col("_1") + F.col("_2")) > confidence, F.lit(False)) & (F.col("_1") + F.col("_2") > 1)
    return v.withColumn("hp", F.when(F.col("_1") > F.col("_2"), 1).when(F.col("_1") < F.col("_2"), 2).otherwise(0)).withColumn("confident", sure & (F.col("_1") != F.col("_2"))).drop("_1", "_2")


def read_votes(obs: DataFrame, assigned: DataFrame, confidence: float = 0.65, low: float = 0.1) -> DataFrame:
    """(chrom, read_id, h1_hi, h1_lo, h2_hi, h2_lo, hp, confident). Modifications don't vote."""
    x = obs.where(F.col("vtype") != MOD).join(assigned.select("chrom", "pos", "hp"), ["chrom", "pos"]).withColumn("hap", F.expr(HAP))
    return _with_verdict(x.groupBy("chrom", "read_id").agg(*[F.sum(c).alias(n) for n, c in _sums().items()]), confidence, low)


def _counts() -> list[Column]:
    n = lambda h, a: F.sum(F.when((F.col("hp") == h) & (F.col("allele") == a), 1).otherwise(0))
    return [n(h, a).alias(f"hp{h}_{'alt' if a else 'ref'}") for h in (1, 2) for a in (0, 1)]


def haplotype_counts(obs: DataFrame, votes: DataFrame) -> DataFrame:
    """(chrom, pos, hp1_ref, hp1_alt, hp2_ref, hp2_alt) over confident reads."""
    x = obs.join(votes.where("confident").select("chrom", "read_id", "hp"), ["chrom", "read_id"])
    return x.groupBy("chrom", "pos").agg(*_counts())


def reassigned(counts: DataFrame, confidence: float = 0.75) -> DataFrame:
    """(chrom, pos, r1, r2, hp): positions whose majority is too small are dropped. Other columns than counts stay."""
    own = [c for c in counts.columns if c not in ("hp1_ref", "hp1_alt", "hp2_ref", "hp2_alt")]
    c = counts.select(*own, (F.col("hp1_ref") + F.col("hp2_alt")).alias("r1"), (F.col("hp2_ref") + F.col("hp1_alt")).alias("r2"))
    keep = F.try_divide(F.greatest("r1", "r2"), F.col("r1") + F.col("r2")) > confidence
    return c.where(keep).withColumn("hp", F.when(F.col("r1") > F.col("r2"), 1).otherwise(2))


def corrected(obs: DataFrame, phased: DataFrame, read_confidence: float = 0.65, snp_confidence: float = 0.75, low: float = 0.1) -> DataFrame:
    """phased, a row a position, with the haplotypes that the reads support; ps is kept.
    Observations take what is known of their position along, so that phased and obs are computed once."""
    rest = [c for c in phased.columns if c not in ("chrom", "pos", "hp")]
    x = obs.select("chrom", "read_id", "pos", "allele", "vtype").join(phased.select("chrom", "pos", "hp", *[F.col(c).alias(f"_{c}") for c in rest]), ["chrom", "pos"])
    x = x.withColumn("hap", F.expr(HAP)).drop("hp")
    read = Window.partitionBy("chrom", "read_id")
    v = _with_verdict(x.select("*", *[F.sum(c).over(read).alias(n) for n, c in _sums().items()]), read_confidence, low)
    counts = v.where("confident").groupBy("chrom", "pos").agg(*_counts(), *[F.first(f"_{c}").alias(c) for c in rest])
    return reassigned(counts, snp_confidence).select("chrom", "pos", *rest, "hp")
