"""Filters over variant records and alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HET = ("0/1", "1/0", "0|1", "1|0")


def is_snp(ref: Column, alts: Column) -> Column:
    one = lambda a: ((F.length(a) == 1) & (a != "*")) | a.isin("<X>", "<*>")
    return one(ref) & F.forall(alts, one)


def is_het(gt: Column) -> Column:
    return gt.isin(*HET)


def biallelic(alt: Column) -> Column:
    return F.size(F.split(alt, ",")) == 1


def quality_kept(qual: Column, least: float) -> Column:
    return (F.coalesce(qual, F.lit(0.0)) >= least) | F.lit(least <= 0)


def phased_het(gt: Column) -> Column:
    return (F.substring(gt, 1, 1) != F.substring(gt, 3, 1)) & (F.substring(gt, 2, 1) == "|")


def last_by_position(variants: DataFrame, order: str) -> DataFrame:
    """One record a position, the last in order."""
    rest = [c for c in variants.columns if c not in ("chrom", "pos")]
    return variants.groupBy("chrom", "pos").agg(F.max_by(F.struct(*rest), order).alias("x")).select("chrom", "pos", "x.*")


def without_conflicts(svs: DataFrame, others: DataFrame) -> DataFrame:
    return svs.join(others.select("chrom", "pos").distinct(), ["chrom", "pos"], "left_anti")


def first_by_position(svs: DataFrame, order: str) -> DataFrame:
    rest = [c for c in svs.columns if c not in ("chrom", "pos")]
    return svs.groupBy("chrom", "pos").agg(F.min_by(F.struct(*rest), order).alias("x")).select("chrom", "pos", "x.*")


def usable_for_phasing(flag: Column, mapq: Column, least: int = 1) -> Column:
    """Mapped, primary or supplementary, not a duplicate."""
    return (flag.bitwiseAND(0x504) == 0) & (mapq >= least)


def usable_for_modcall(flag: Column, mapq: Column) -> Column:
    return (flag.bitwiseAND(0xD04) == 0) & (mapq >= 1)


def route(flag: Column, mapq: Column, start: Column, last_variant: Column, least: int = 1, supplementary: bool = False) -> Column:
    """What haplotag does with an alignment; the first case that applies."""
    out = F.when(mapq < least, "low_mapq").when(flag.bitwiseAND(4) != 0, "unmapped").when(flag.bitwiseAND(0x100) != 0, "secondary")
    if not supplementary:
        out = out.when(flag.bitwiseAND(0x800) != 0, "supplementary")
    return out.when(last_variant.isNull(), "no_variants").when(start > last_variant, "beyond").otherwise("judge")


def crowded_homopolymers(snps: DataFrame, gap: int = 2, run: int = 3) -> DataFrame:
    """SNPs to drop: walking in order, a SNP in a homopolymer removes a following one within the gap that is in one too;
    the one that stays is compared on. snps: (chrom, pos, run). Chains of close SNPs are folded one by one."""
    w = Window.partitionBy("chrom").orderBy("pos")
    x = snps.where(F.col("run") >= run).withColumn("_new", (F.coalesce(F.col("pos") - F.lag("pos").over(w), F.lit(gap + 1)) > gap).cast("int"))
    x = x.withColumn("_chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    zero = F.struct(F.lit(None).cast("long").alias("kept"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        near = acc["kept"].isNotNull() & (p - acc["kept"] <= gap)
        return F.when(near, F.struct(acc["kept"].alias("kept"), F.array_append(acc["out"], p).alias("out"))).otherwise(F.struct(p.alias("kept"), acc["out"].alias("out")))

    chain = x.groupBy("chrom", "_chain").agg(F.array_sort(F.collect_list(F.col("pos").cast("long"))).alias("ps")).where("size(ps) > 1")
    return chain.select("chrom", F.explode(F.aggregate("ps", zero, step, lambda a: a["out"])).alias("pos"))
