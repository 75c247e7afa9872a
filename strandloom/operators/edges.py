"""The allele co-occurrence graph: pairs of observations of a read, edge weights and the decision on an edge.

obs: (chrom, read_id, pos, allele 0/1, qual, vtype). All counts are integers; a pair of good qualities counts in
``*_hi``, any other in ``*_lo``, so that the fractional weight of the latter enters only in a decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.params import MOD, SNP

CLASSES = ("rr", "ra", "ar", "aa")


def following(obs: DataFrame, n: int) -> DataFrame:
    """Each observation with those of the next n of its read: one shuffle on the read, no self-join."""
    order = ["pos", "vtype", "allele", "qual"]
    w = Window.partitionBy("chrom", "read_id").orderBy(*order).rowsBetween(1, n)
    nxt = F.collect_list(F.struct(F.col("pos").alias("p2"), F.col("allele").alias("allele2"), F.col("qual").alias("qual2"), F.col("vtype").alias("vtype2"))).over(w)
    return (
        obs.select("chrom", "read_id", F.col("pos").alias("p1"), F.col("allele").alias("allele1"), F.col("qual").alias("qual1"), F.col("vtype").alias("vtype1"), nxt.alias("next"))
        .withColumn("n", F.explode("next")).drop("next").select("*", "n.*").drop("n")
    )


def edge_weights(obs: DataFrame, n: int = 35, min_quality: int = 12) -> DataFrame:
    """(chrom, p1, p2) with the eight counters. The sums are partial before the shuffle."""
    good = (F.col("qual1") >= min_quality) & (F.col("qual2") >= min_quality)
    kind = lambda a, b: (F.col("allele1") == a) & (F.col("allele2") == b)
    cell = {"rr": (0, 0), "ra": (0, 1), "ar": (1, 0), "aa": (1, 1)}
    sums = [F.sum(F.when(kind(*cell[c]) & (good if h == "hi" else ~good), 1).otherwise(0)).alias(f"{c}_{h}") for c in CLASSES for h in ("hi", "lo")]
    return following(obs, n).where("p1 < p2").groupBy("chrom", "p1", "p2").agg(*sums)


def weight(c: str, low: float) -> Column:
    return F.col(f"{c}_hi") + F.lit(low) * F.col(f"{c}_lo")


def judged(edges: DataFrame, threshold: float = 0.7, low: float = 0.1) -> DataFrame:
    """Adds para, cross, ratio, vote weight, and the decision (1 same, -1 flipped, 0 none) twice: ``mixed`` between a SNP and a modification, ``plain`` between others."""
    e = edges.withColumn("para", F.round(weight("rr", low) + weight("aa", low), 6)).withColumn("cross", F.round(weight("ra", low) + weight("ar", low), 6))
    para, cross = F.col("para"), F.col("cross")
    e = e.withColumn("ratio", F.round(F.try_divide(F.least(para, cross), F.greatest(para, cross)), 9))
    ratio = F.col("ratio")
    decision = lambda bound: F.when(ratio.isNull() | (ratio > bound) | (para == cross), 0).when(para > cross, 1).otherwise(-1)
    e = e.withColumn("mixed", decision(F.when(para + cross < 1, -1.0).otherwise(0.3))).withColumn("plain", decision(F.lit(threshold)))
    strong = ((ratio <= 0.1) & (para + cross >= 1)) | ((para >= 1) != (cross >= 1))
    return e.withColumn("weight", F.when(strong, 20).otherwise(1))


def decided(edges: DataFrame, node_types: DataFrame, threshold: float = 0.7, low: float = 0.1) -> DataFrame:
    """Adds para, cross, ratio, decision (1 same, -1 flipped, 0 none) and vote weight. node_types: (chrom, pos, vtype)."""
    t = lambda p, name: node_types.select(F.col("chrom"), F.col("pos").alias(p), F.col("vtype").alias(name))
    e = judged(edges.join(t("p1", "t1"), ["chrom", "p1"]).join(t("p2", "t2"), ["chrom", "p2"]), threshold, low)
    snp_mod = ((F.col("t1") == SNP) & (F.col("t2") == MOD)) | ((F.col("t1") == MOD) & (F.col("t2") == SNP))
    return e.withColumn("decision", F.when(snp_mod, F.col("mixed")).otherwise(F.col("plain"))).drop("mixed", "plain")


#: Bits of a packed link below the distance: decisions + 1 between a SNP and a modification and between others, high weight, few votes, clear ratio.
LINK_BITS = 7


def packed(mixed: Column, plain: Column) -> Column:
    """A judged edge as one long, in order of p2: its length, then the bits that a walk asks for."""
    bit = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    few, clear = F.col("para") + F.col("cross") <= 1, F.col("ratio") < 0.2
    low = (mixed + 1) * 32 + (plain + 1) * 8 + bit(F.col("weight") == 20) * 4 + bit(few) * 2 + bit(clear)
    return F.shiftleft(F.col("p2") - F.col("p1"), LINK_BITS) + low


def neighbourhoods(obs: DataFrame, n: int = 35, min_quality: int = 12, threshold: float = 0.7, low: float = 0.1) -> DataFrame:
    """(chrom, pos, vtype, far, links): nodes with the last position that an edge reaches and their packed edges that any types decide.

    Observations travel once by read and once by position, each with those that follow it, and pairs are made and counted where they
    arrive: neither pairs nor edges are shuffled.
    """
    # allele and quality as one number, 2 where a state is none of those that count
    allele = F.when(F.col("allele") == 0, 0).when(F.col("allele") == 1, 1).otherwise(2)
    quality = F.when(F.col("qual") >= min_quality, 1).when(F.col("qual") < min_quality, 0).otherwise(2)
    own = obs.select("chrom", "read_id", "pos", "vtype", "allele", "qual", (allele * 3 + quality).alias("c"))
    w = Window.partitionBy("chrom", "read_id").orderBy("pos", "vtype", "allele", "qual").rowsBetween(1, n)
    x = own.select("chrom", F.col("pos").alias("p1"), "vtype", F.col("c").alias("c1"), F.collect_list(F.struct(F.col("pos").alias("p2"), F.col("c").alias("c2"))).over(w).alias("next"))
    x = x.withColumn("next", F.filter("next", lambda y: y["p2"] > F.col("p1"))).repartition("chrom", "p1")
    x = x.select("chrom", "p1", "vtype", "c1", F.explode_outer("next").alias("y")).select("chrom", "p1", "vtype", "c1", "y.p2", "y.c2")
    # a count for each pair of numbers that counts
    kind = lambda k, q1, q2: (F.col("c1") == k // 2 * 3 + q1) & (F.col("c2") == k % 2 * 3 + q2)
    sums = []
    for k, c in enumerate(CLASSES):
        sums.append(F.count_if(kind(k, 1, 1)).alias(f"{c}_hi"))
        sums.append(F.count_if(kind(k, 0, 0) | kind(k, 0, 1) | kind(k, 1, 0) | kind(k, 0, 2) | kind(k, 2, 0)).alias(f"{c}_lo"))
    e = judged(x.groupBy("chrom", "p1", "p2").agg(F.min("vtype").alias("vtype"), *sums), threshold, low)
    link = F.when(F.col("p2").isNotNull() & ((F.col("mixed") != 0) | (F.col("plain") != 0)), packed(F.col("mixed"), F.col("plain")))
    return e.groupBy("chrom", F.col("p1").alias("pos")).agg(F.min("vtype").alias("vtype"), F.max("p2").alias("far"), F.collect_list(link).alias("links"))


def node_types(obs: DataFrame) -> DataFrame:
    return obs.groupBy("chrom", "pos").agg(F.min("vtype").alias("vtype"))


def dot_lines(edges: DataFrame) -> DataFrame:
    """Lines of a DOT graph, one a decided edge, positions 1-based."""
    label = lambda p, a: F.concat((F.col(p) + 1).cast("string"), F.lit(f".{a}"))
    same = F.col("decision") == 1
    return edges.where("decision <> 0").select("chrom", "p1", "p2", F.concat(label("p1", 1), F.lit(" -> "), F.when(same, label("p2", 1)).otherwise(label("p2", 2))).alias("line"))
