"""The three commands as lazy plans. Nothing here runs a job but where a docstring says so."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import cigar, cnv, correct, depth, methyl, overlap, phase, ranges, tag, variants
from strandloom.params import HaplotagParams, ModcallParams, PhaseParams


def phase_observations(obs: DataFrame, params: PhaseParams = PhaseParams()) -> DataFrame:
    """(chrom, pos, gt, ps) from clean observations (chrom, read_id, pos, allele, qual, vtype). Runs a job: see phase.walked()."""
    walked = phase.walked(obs, params.distance, params.adjacent, params.base_quality, params.edge_threshold, params.low_weight)
    placed = phase.blocks(walked)
    return phase.export(correct.corrected(obs, placed, params.read_confidence, params.snp_confidence, params.low_weight))


def mod_observations(reads: DataFrame, mods: DataFrame) -> DataFrame:
    """Observations at modifications: reads that carry evidence, on the same strand, spanning the position. Modified is allele 0."""
    r = reads.select("chrom", "aln_id", "read_id", F.col("qname").alias("read_name"), "pos", cigar.end_position(F.col("pos"), F.col("cigar"), F.col("flag")).alias("end"), (F.col("flag").bitwiseAND(16) != 0).alias("is_reverse"))
    m = mods.select("chrom", "read_name", "is_reverse", F.col("representative").alias("vpos"), "is_modify").distinct()
    x = r.join(m, ["chrom", "read_name", "is_reverse"]).where((F.col("vpos") >= F.col("pos")) & (F.col("vpos") < F.col("end")))
    return x.select("chrom", "aln_id", "read_id", F.col("vpos").alias("pos"), F.when(F.col("is_modify"), 0).otherwise(1).alias("allele"), F.lit(60).alias("qual"), F.lit(2).alias("vtype"))


def observe(reads: DataFrame, snps: DataFrame, svs: DataFrame | None = None, mods: DataFrame | None = None, homopolymers: DataFrame | None = None, params: PhaseParams = PhaseParams()) -> DataFrame:
    """All observations of usable reads. reads: (chrom, aln_id, read_id, qname, pos, mapq, flag, cigar, seq, qual); snps: (chrom, pos, ref, alt[, is_repeat])."""
    good = reads.where(variants.usable_for_phasing(F.col("flag"), F.col("mapq"), params.mapping_quality))
    v = snps.withColumnRenamed("pos", "vpos")
    v = v if "is_repeat" in v.columns else v.withColumn("is_repeat", F.lit(False))
    out = cigar.observations(good.select("chrom", "aln_id", "read_id", "pos", "cigar", "seq", "qual"), v, homopolymers)
    if svs is not None:
        out = out.unionByName(cigar.sv_observations(good, svs, params.sv_window, params.sv_threshold))
    if mods is not None:
        out = out.unionByName(mod_observations(good, mods))
    return out


def phase_reads(reads: DataFrame, snps: DataFrame, svs: DataFrame | None = None, mods: DataFrame | None = None, homopolymers: DataFrame | None = None, params: PhaseParams = PhaseParams()) -> DataFrame:
    """(chrom, pos, gt, ps). Runs a job: see phase.walked(). For ONT reads, SNPs in crowded homopolymers (``homopolymers``: chrom, vpos, run) are left out."""
    if params.ont and homopolymers is not None:
        runs = snps.join(homopolymers.select("chrom", F.col("vpos").alias("pos"), "run"), ["chrom", "pos"])
        snps = variants.without_conflicts(snps, variants.crowded_homopolymers(runs.select("chrom", "pos", "run")))
    obs = observe(reads, snps, svs, mods, homopolymers, params)
    obs = overlap.without_overlaps(obs, params.overlap)
    iv = cnv.cnv_intervals(_numbered(cigar.clip_histogram(reads), obs))
    obs = cnv.without_misses(obs, cnv.miss_rates(obs, iv))
    return phase_observations(obs, params)


def _numbered(histogram: DataFrame, obs: DataFrame) -> DataFrame:
    """The histogram with chrom as in obs."""
    return histogram.select(F.col("chrom").cast(obs.schema["chrom"].dataType).alias("chrom"), "pos", "front", "back")


def haplotag(reads: DataFrame, phased: DataFrame, svs: DataFrame | None = None, mods: DataFrame | None = None, homopolymers: DataFrame | None = None, params: HaplotagParams = HaplotagParams()) -> DataFrame:
    """Every alignment with route, hp, ps, pq and votes. phased: (chrom, pos, ref, alt, hp, ps); svs: (chrom, pos, svlen, sv_hp); mods: (read_id, h1, h2)."""
    last = phased.groupBy("chrom").agg(F.max("pos").alias("last_pos"))
    r = reads.join(F.broadcast(last), "chrom", "left")  # one row a contig
    r = r.withColumn("route", variants.route(F.col("flag"), F.col("mapq"), F.col("pos"), F.col("last_pos"), params.mapping_quality, params.tag_supplementary)).drop("last_pos")
    judge = r.where("route = 'judge'")
    v = phased.select("chrom", F.col("pos").alias("vpos"), "ref", "alt", F.lit(False).alias("is_repeat"))
    obs = cigar.observations(judge.select("chrom", "aln_id", "read_id", "pos", "cigar", "seq", "qual"), v, homopolymers)
    votes = tag.votes(obs, phased, ("chrom", "aln_id", "read_id"))
    if svs is not None:
        ops = cigar.blocks(judge, ["chrom", "read_id"]).select("chrom", "read_id", F.col("ref_start").alias("ref_pos"), "op", "len")
        votes = tag.with_extra(votes, tag.sv_votes(ops, svs, params.sv_threshold))
    if mods is not None:
        votes = tag.with_extra(votes, mods)
    j = tag.judged(votes, params.percentage).select("aln_id", "h1", "h2", "n_ps", "ps", "total", "hp", "pq")
    return r.join(j, "aln_id", "left").withColumn("hp", F.coalesce("hp", F.lit(0)))


def modcall(reads: DataFrame, calls: DataFrame, snp_obs: DataFrame | None = None, params: ModcallParams = ModcallParams()) -> DataFrame:
    """Sites (chrom, pos, strand, counts, depth, gt, read lists) that are heterozygous and connected.
    calls: (chrom, aln_id, read_name, strand, qpos, prob) of 5mC; reads as for observe(); snp_obs: observations at SNPs, or none."""
    good = reads.where(variants.usable_for_modcall(F.col("flag"), F.col("mapq")))
    b = cigar.blocks(good, ["chrom", "aln_id", "read_id"]).where(F.col("op").isin(*cigar.BOTH))
    c = calls.select("aln_id", "read_name", "strand", "qpos", "prob")
    # a block's end is inclusive, so a call on the first base after it is the block's; of two the first
    x = b.join(c, "aln_id").where((F.col("qpos") >= F.col("query_start")) & (F.col("qpos") <= F.col("query_start") + F.col("len")))
    x = x.groupBy("chrom", "aln_id", "read_id", "read_name", "strand", "qpos").agg(F.min_by(F.struct("ref_start", "query_start"), "op_index").alias("b"), F.first("prob").alias("prob"))
    x = x.withColumn("pos", F.col("b.ref_start") + F.col("qpos") - F.col("b.query_start")).withColumn("call", methyl.call(F.col("prob"), params.modified, params.unmodified)).withColumn("scan_ord", F.col("aln_id"))
    if snp_obs is not None:
        x = variants.without_conflicts(x, snp_obs)
    sites = methyl.site_counts(x)
    span = good.select("chrom", F.col("flag").bitwiseAND(16).cast("int").alias("_f"), F.col("pos").alias("s"), cigar.end_position(F.col("pos"), F.col("cigar"), F.col("flag")).alias("e"))
    span = span.withColumn("strand", F.when(F.col("_f") != 0, 1).otherwise(0))
    at = ranges.point_join(span.withColumn("e1", F.col("e") - 1), sites.select("chrom", F.col("strand").alias("site_strand"), "pos"), ["chrom"], "s", "e1", "pos").where("site_strand is null or strand = site_strand")
    sites = sites.join(at.groupBy("chrom", "pos").agg(F.count("*").alias("depth")), ["chrom", "pos"], "left").fillna(0, ["depth"])
    sites = methyl.genotyped(sites, params.heterozygous, params.noise)
    het = sites.where("gt = '0/1'").select("chrom", "pos", F.when((F.col("strand") == 1) & F.col("paired"), F.col("pos") - 1).otherwise(F.col("pos")).alias("node"))
    obs = x.where("call <> 'noise'").join(het, ["chrom", "pos"]).select("chrom", "read_id", F.col("node").alias("pos"), F.when(F.col("call") == "mod", 0).otherwise(1).alias("allele"), F.lit(60).alias("qual"), F.lit(2).alias("vtype"))
    if snp_obs is not None:
        obs = obs.unionByName(snp_obs.where("vtype = 0").select(obs.columns))
    if params.all_sites:
        return sites
    passed = methyl.connected(*methyl.graph(obs.distinct()), params.adjacent, params.confidence, params.rounds, snp_obs is not None)
    both = het.join(passed.select("chrom", F.col("pos").alias("node")), ["chrom", "node"], "left_semi").select("chrom", "pos")
    return sites.join(both, ["chrom", "pos"], "left_semi")


def depth_of(reads: DataFrame) -> DataFrame:
    r = reads.select("chrom", "pos", cigar.end_position(F.col("pos"), F.col("cigar"), F.col("flag")).alias("e"), F.when(F.col("flag").bitwiseAND(16) != 0, 1).otherwise(0).alias("strand"))
    return depth.depth_sweep(r.withColumnRenamed("pos", "s"), ["chrom", "strand"], "s", "e")


def modcall_lines(sites: DataFrame, ref_bases: DataFrame) -> DataFrame:
    """VCF lines of sites whose reference base (chrom, pos, base) is one of ACGT."""
    x = sites.join(ref_bases, ["chrom", "pos"]).where(F.col("base").rlike("^[ACGTacgt]$") & F.col("strand").isNotNull())
    info = F.concat(F.lit("RS="), F.when(F.col("strand") == 0, "P").otherwise("N"), F.lit(";MR="), F.array_join("mod_reads", ","), F.lit(";NR="), F.array_join("unmod_reads", ","), F.lit(";"))
    sample = F.concat_ws(":", "gt", *[F.col(c).cast("string") for c in ("n_mod", "n_unmod", "depth")])
    return x.select("chrom", "pos", F.concat_ws("\t", F.col("chrom").cast("string"), (F.col("pos") + 1).cast("string"), F.lit("."), F.upper("base"), F.lit("N"), F.lit("."), F.lit("PASS"), info, F.lit("GT:MD:UD:DP"), sample).alias("line"))
