"""Modification sites: counts, genotypes, strand pairs, and the sites that consistent reads connect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.edges import edge_weights
from strandloom.params import MOD, SNP
from strandloom.sources import shared


def call(prob: Column, modified: float = 0.8, unmodified: float = 0.2) -> Column:
    """'mod', 'unmod' or 'noise' of a probability 0..255."""
    return F.when(prob >= modified * 255, "mod").when(prob <= unmodified * 255, "unmod").otherwise("noise")


def site_counts(calls: DataFrame) -> DataFrame:
    """calls: (chrom, pos, read_name, strand, call, scan_ord). Read lists are in scan order; strand is the last modified read's."""
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("call") == c, F.struct("scan_ord", "read_name")))), lambda x: x["read_name"])
    n = lambda c: F.count_if(F.col("call") == c)
    return calls.groupBy("chrom", "pos").agg(
        n("mod").alias("n_mod"), n("unmod").alias("n_unmod"), n("noise").alias("n_noise"),
        F.max_by(F.when(F.col("call") == "mod", F.col("strand")), F.when(F.col("call") == "mod", F.col("scan_ord"))).alias("strand"),
        listed("mod").alias("mod_reads"), listed("unmod").alias("unmod_reads"),
    )


def genotype(n_mod: Column, n_unmod: Column, depth: Column, het: float = 0.6, noise: float = 0.2) -> Column:
    """0/1 where both states are frequent and the rest is not noise; null without any call. Depth 0 counts as no noise."""
    ratio = F.try_divide(F.least(n_mod, n_unmod).cast("double"), F.greatest(n_mod, n_unmod))
    rest = F.try_divide((depth - n_mod - n_unmod).cast("double"), depth)
    quiet = F.coalesce(rest <= noise, depth - n_mod - n_unmod < 0)
    return F.when(F.greatest(n_mod, n_unmod) == 0, F.lit(None)).when((ratio >= het) & quiet, "0/1").when(n_mod >= n_unmod, "1/1").otherwise("0/0")


def strand_pairs(sites: DataFrame, het: float = 0.6, noise: float = 0.2) -> DataFrame:
    """Forward sites with a reverse site one position on: summed counts and their genotype."""
    plus = sites.where("strand = 0").select("chrom", "pos", *[F.col(c).alias(f"{c}_p") for c in ("n_mod", "n_unmod", "depth")])
    minus = sites.where("strand = 1").select("chrom", (F.col("pos") - 1).alias("pos"), *[F.col(c).alias(f"{c}_m") for c in ("n_mod", "n_unmod", "depth")])
    x = plus.join(minus, ["chrom", "pos"])
    both = [(F.col(f"{c}_p") + F.col(f"{c}_m")).alias(c) for c in ("n_mod", "n_unmod", "depth")]
    return x.select("chrom", "pos", *both).withColumn("gt", genotype(F.col("n_mod"), F.col("n_unmod"), F.col("depth"), het, noise)).where("gt is not null")


def genotyped(sites: DataFrame, het: float = 0.6, noise: float = 0.2) -> DataFrame:
    """sites with gt; a pair's genotype replaces those of both its sites, and paired tells which sites it did."""
    p = strand_pairs(sites, het, noise).select("chrom", "pos", F.col("gt").alias("_pair"))
    both = p.select("chrom", F.explode(F.array(F.struct(F.col("pos").alias("p"), F.col("_pair").alias("g")), F.struct((F.col("pos") + 1).alias("p"), F.col("_pair").alias("g")))).alias("x")).select("chrom", F.col("x.p").alias("pos"), F.col("x.g").alias("_pair"))
    own = genotype(F.col("n_mod"), F.col("n_unmod"), F.col("depth"), het, noise)
    return sites.join(both, ["chrom", "pos"], "left").withColumn("gt", F.coalesce("_pair", own)).withColumn("paired", F.col("_pair").isNotNull()).drop("_pair")


def graph(obs: DataFrame, n: int = 50) -> tuple[DataFrame, DataFrame]:
    """Nodes (chrom, pos, vtype, n_reads) and pair counts (chrom, p1, p2, same, flipped) without pairs of SNPs."""
    # reads are told apart by their order, which a task needs less memory for than for tables of them
    before = F.lag("read_id").over(Window.partitionBy("chrom", "pos").orderBy("read_id"))
    own = obs.select("chrom", "pos", "vtype", "read_id", (F.col("read_id").isNotNull() & (before.isNull() | (before != F.col("read_id")))).alias("new"))
    node = own.groupBy("chrom", "pos").agg(F.min_by("vtype", "read_id").alias("vtype"), F.count_if("new").alias("n_reads"))
    e = edge_weights(obs, n, 0)
    t = node.select("chrom", "pos", "vtype")
    e = e.join(t.withColumnsRenamed({"pos": "p1", "vtype": "t1"}), ["chrom", "p1"]).join(t.withColumnsRenamed({"pos": "p2", "vtype": "t2"}), ["chrom", "p2"])
    e = e.where((F.col("t1") != SNP) | (F.col("t2") != SNP))
    return node, e.select("chrom", "p1", "p2", (F.col("rr_hi") + F.col("aa_hi")).alias("same"), (F.col("ra_hi") + F.col("ar_hi")).alias("flipped"))


def _supported(node: DataFrame, pairs: DataFrame, confidence: float) -> DataFrame:
    """One row a pair that any rule asks for: its ends' kinds and ranks on the contig, whether enough reads show it
    (``firm``), whether they agree (``sure``), and whether it holds neighbours together (``holds``)."""
    at = node.withColumn("rank", F.row_number().over(Window.partitionBy("chrom").orderBy("pos")))
    one, two = (at.select("chrom", F.col("pos").alias(f"p{k}"), F.col("vtype").alias(f"t{k}"), F.col("n_reads").alias(f"n{k}"), F.col("rank").alias(f"k{k}")) for k in (1, 2))
    total, most = F.col("same") + F.col("flipped"), F.greatest("same", "flipped")
    x = pairs.join(one, ["chrom", "p1"]).join(two, ["chrom", "p2"])
    x = x.withColumn("firm", (total > 6) & (4 * total > F.col("n1") + F.col("n2"))).withColumn("sure", F.col("firm") & (most >= confidence * total))
    return x.withColumn("holds", (total >= 6) & (most >= confidence * total)).where("firm or holds").select("chrom", "p1", "p2", "t1", "t2", "k1", "k2", "firm", "sure", "holds")


def _unbroken(pairs: DataFrame, place: str) -> DataFrame:
    """The firm pairs of a site up to the first partner that lacks one: ``place`` counts the partners it would have met, from 1."""
    n = F.row_number().over(Window.partitionBy("chrom", "p1").orderBy(place))
    return pairs.where("firm").withColumn("_n", n).where(F.col("_n") == F.col(place)).drop("_n")


def _ends(pairs: DataFrame, flag: str) -> DataFrame:
    return pairs.select("chrom", F.explode(F.array("p1", "p2")).alias("pos")).distinct().withColumn(flag, F.lit(True))


def _among(state: DataFrame, member: str, pairs: DataFrame, adjacent: int, either: str | None = None) -> DataFrame:
    """Unbroken pairs between members, which meet the next ``adjacent`` members; with ``either``, only partners of which one has that flag."""
    w = Window.partitionBy("chrom").orderBy("pos")
    m = state.where(member).select("chrom", "pos", F.row_number().over(w).alias("m"), *([F.col(either).alias("e"), F.count_if(either).over(w).alias("c")] if either else []))
    one, two = (m.select("chrom", F.col("pos").alias(f"p{k}"), *[F.col(c).alias(f"{c}{k}") for c in m.columns[2:]]) for k in (1, 2))
    x = pairs.where("firm").join(one, ["chrom", "p1"]).join(two, ["chrom", "p2"]).where(F.col("m2") - F.col("m1") <= adjacent)
    place = F.col("m2") - F.col("m1")
    if either:
        x, place = x.where("e1 or e2"), F.when(F.col("e1"), place).otherwise(F.col("c2") - F.col("c1"))
    return _unbroken(x.withColumn("place", place), "place")


def connected(node: DataFrame, pairs: DataFrame, adjacent: int = 20, confidence: float = 0.9, rounds: int = 2, with_snps: bool = True) -> DataFrame:
    """(chrom, pos) of the sites that pass, as rules on one frame of supported pairs.

    A site looks forward along its contig until a partner lacks support. It is strong if it surely agrees with a SNP on
    its way; a SNP that surely agrees with a site makes the node after it strong; without SNPs every site is strong.
    Strong sites that surely agree pass. Then, in rounds, sites that meet no SNP are joined to those added before. What
    passes stays if it also agrees with both neighbours among SNPs and passed sites; at an end of a contig one is enough
    or none. No nodes or pairs: no rows.

    Runs jobs: pairs and the state after each pass are checkpointed (a row a node, a few flags). Ranks come from windows
    over a contig's nodes, which are aggregated sites; pairs are only windowed by their first site.
    """
    spark = node.sparkSession
    shared.set_checkpoints(spark)
    node = node.select("chrom", "pos", "vtype", "n_reads").checkpoint()
    # a pair opens its first site even where it has no support
    opens = pairs.select("chrom", F.col("p1").alias("pos")).distinct().withColumn("opens", F.lit(True))
    firm = _supported(node, pairs, confidence).checkpoint()
    state = node.select("chrom", "pos", "vtype").join(opens, ["chrom", "pos"], "left")
    if with_snps:
        way = _unbroken(firm.withColumn("place", F.col("k2") - F.col("k1")), "place")
        forward = way.where((F.col("t1") == MOD) & (F.col("t2") == SNP) & (F.col("place") <= adjacent))
        back = way.where((F.col("t1") == SNP) & (F.col("t2") == MOD))
        own = forward.groupBy("chrom", F.col("p1").alias("pos")).agg(F.max("sure").alias("strong"))
        met = back.select("chrom", F.col("p2").alias("pos")).distinct().withColumn("met", F.lit(True))
        after = way.where("place = 1").join(back.where("sure").select("chrom", "p1").distinct(), ["chrom", "p1"], "left_semi").select("chrom", F.col("p2").alias("pos"), F.lit(True).alias("next"))
        state = state.join(own, ["chrom", "pos"], "left").join(met, ["chrom", "pos"], "left").join(after, ["chrom", "pos"], "left")
        weak = F.col("opens") & (F.col("vtype") == MOD) & F.col("strong").isNull() & F.col("met").isNull()
        strong = F.coalesce("strong", F.lit(False)) | F.coalesce("next", F.lit(False))
        flags = {"strong": strong, "weak": weak, "passed": F.col("opens") & (F.col("vtype") == SNP)}
    else:
        flags = {"strong": F.col("vtype") == MOD, "weak": F.lit(False), "passed": F.lit(False)}
    yes = lambda c: F.coalesce(c, F.lit(False))
    state = state.select("chrom", "pos", "vtype", yes(F.col("opens")).alias("opens"), *[yes(v).alias(k) for k, v in flags.items()]).checkpoint()

    added = _ends(_among(state, "strong", firm, adjacent).where("sure"), "new")
    state = state.join(added, ["chrom", "pos"], "left").withColumn("added", yes(F.col("new"))).drop("new")
    state = state.withColumn("passed", F.col("passed") | F.col("added")).withColumn("weak", F.col("weak") | F.col("added")).checkpoint()
    for _ in range(rounds if with_snps else 0):
        new = _ends(_among(state, "weak", firm, adjacent, "added").where("sure"), "new")
        w = Window.partitionBy("chrom", "weak").orderBy("pos").rowsBetween(1, adjacent)
        idle = F.col("weak") & F.col("opens") & ~F.when(F.col("added"), F.count("*").over(w) > 0).otherwise(F.count_if("added").over(w) > 0)
        x = state.withColumn("idle", idle).join(new, ["chrom", "pos"], "left").withColumn("new", yes(F.col("new")) & ~F.col("passed"))
        state = x.select("chrom", "pos", "vtype", "opens", "strong", (F.col("new") | F.col("idle")).alias("weak"), (F.col("passed") | F.col("new")).alias("passed"), F.col("new").alias("added")).checkpoint()

    w = Window.partitionBy("chrom").orderBy("pos")
    p = state.where("passed").select("chrom", "pos", "vtype", F.lag("pos").over(w).alias("before"), F.lag("opens").over(w).alias("before_opens"), F.lead("pos").over(w).alias("after"))
    p = p.where(F.col("vtype") != SNP)
    holds = firm.where("holds").select("chrom", "p1", "p2")
    left = holds.select("chrom", F.col("p1").alias("before"), F.col("p2").alias("pos"), F.lit(True).alias("left"))
    right = holds.select("chrom", F.col("p1").alias("pos"), F.col("p2").alias("after"), F.lit(True).alias("right"))
    p = p.join(left, ["chrom", "before", "pos"], "left").join(right, ["chrom", "pos", "after"], "left")
    return p.where("before is null or (after is null and before_opens) or (left and right)").select("chrom", "pos")


def neighbours_agree(candidates: DataFrame, pairs: DataFrame, confidence: float = 0.9, least: int = 6) -> DataFrame:
    """Candidates (chrom, pos) joined by consistent reads to both neighbours among the candidates; the first and last stay."""
    w = Window.partitionBy("chrom").orderBy("pos")
    x = candidates.select("chrom", "pos", F.lag("pos").over(w).alias("before"), F.lead("pos").over(w).alias("after"))
    ok = (F.col("same") + F.col("flipped") >= least) & (F.greatest("same", "flipped") >= confidence * (F.col("same") + F.col("flipped")))
    good = pairs.where(ok).select("chrom", "p1", "p2")
    x = x.join(good.select("chrom", F.col("p1").alias("before"), F.col("p2").alias("pos"), F.lit(True).alias("b")), ["chrom", "before", "pos"], "left")
    x = x.join(good.select("chrom", F.col("p1").alias("pos"), F.col("p2").alias("after"), F.lit(True).alias("a")), ["chrom", "pos", "after"], "left")
    return x.where("before is null or after is null or (a and b)").select("chrom", "pos")

