"""The registered queries: each applies operators of the library to the bound views; most have the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import alleles, filters, strings
from strandloom.operators import cigar, cnv, correct, depth, edges, headers, likelihood, methyl, overlap, phase, pileup, ranges, realign, tag, variants
from strandloom.plans.bindings import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, *views: str, sql: str | None = None):
    """Registers f(views...) -> DataFrame under a name; sql reads the same views."""

    def add(f: Callable[..., DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(*[view(spark, sf_dir, v) if not v.startswith("@") else spark.read.parquet(f"{sf_dir}/{v[1:]}.parquet") for v in views])
        if sql:
            own = [v for v in views if not v.startswith("@")]
            ORACLE_SQL[name] = with_views(sql, *own) if own else sql
        return f

    return add


# -- filters -----------------------------------------------------------------------------------------------------------
@query("f01_snp_test", "variants", sql="SELECT chrom, pos FROM variants WHERE length(ref) = 1 AND alt NOT LIKE '%GT' AND NOT (alt LIKE '%,%' AND length(alt) <> 3)")
def _(v):
    return v.where(variants.is_snp(F.col("ref"), F.split("alt", ","))).select("chrom", "pos")


@query("f02_het_filter", "variants", sql="SELECT chrom, pos, gt FROM variants WHERE gt IN ('0/1','1/0','0|1','1|0')")
def _(v):
    return v.where(variants.is_het(F.col("gt"))).select("chrom", "pos", "gt")


@query("f03_biallelic", "variants", sql="SELECT chrom, pos, alt FROM variants WHERE alt NOT LIKE '%,%'")
def _(v):
    return v.where(variants.biallelic(F.col("alt"))).select("chrom", "pos", "alt")


@query("f06_qual_filter", "variants", sql="SELECT chrom, pos, coalesce(qual, 0) >= 20 AS kept FROM variants")
def _(v):
    return v.select("chrom", "pos", variants.quality_kept(F.col("qual"), 20.0).alias("kept"))


@query("f07_phased_het", "variants", sql="SELECT chrom, pos FROM variants WHERE substring(gt,1,1) <> substring(gt,3,1) AND substring(gt,2,1) = '|'")
def _(v):
    return v.where(variants.phased_het(F.col("gt"))).select("chrom", "pos")


@query("f08_flag_filter", "aln", sql="SELECT chrom, read_id FROM aln WHERE (flag2 & 1284) = 0 AND mapq >= 20")
def _(a):
    return a.where(variants.usable_for_phasing(F.col("flag2"), F.col("mapq"), 20)).select("chrom", "read_id")


@query("f09_modcall_filter", "aln", sql="SELECT chrom, read_id FROM aln WHERE (flag2 & 3332) = 0 AND mapq >= 1")
def _(a):
    return a.where(variants.usable_for_modcall(F.col("flag2"), F.col("mapq"))).select("chrom", "read_id")


_ROUTE = "CASE WHEN mapq < 30 THEN 'low_mapq' WHEN (flag2 & 4) <> 0 THEN 'unmapped' WHEN (flag2 & 256) <> 0 THEN 'secondary' WHEN (flag2 & 2048) <> 0 THEN 'supplementary' WHEN last_pos IS NULL THEN 'no_variants' WHEN start_pos > last_pos THEN 'beyond' ELSE 'judge' END"


def _routed(a: DataFrame, v: DataFrame) -> DataFrame:
    last = v.where("chrom < 2").groupBy("chrom").agg((F.max("pos") - 40).alias("last_pos"))
    x = a.join(F.broadcast(last), "chrom", "left")  # one row a chromosome
    return x.withColumn("route", variants.route(F.col("flag2"), F.col("mapq"), F.col("start_pos"), F.col("last_pos"), 30))


@query("f10_route_case", "aln", "variants", sql=f"SELECT chrom, read_id, {_ROUTE} AS route FROM aln LEFT JOIN (SELECT chrom AS c, max(pos) - 40 AS last_pos FROM variants WHERE chrom < 2 GROUP BY chrom) l ON chrom = c")
def _(a, v):
    return _routed(a, v).select("chrom", "read_id", "route")


@query("f11_anti_conflict", "sv", "variants", sql="SELECT chrom, pos, ord FROM sv s WHERE NOT EXISTS (SELECT 1 FROM variants v WHERE v.vtype = 0 AND v.chrom = s.chrom AND v.pos = s.pos)")
def _(s, v):
    return variants.without_conflicts(s, v.where("vtype = 0")).select("chrom", "pos", "ord")


@query("f12_dup_drop", "sv", sql="SELECT chrom, pos, min(ord) AS ord FROM sv GROUP BY chrom, pos")
def _(s):
    return variants.first_by_position(s, "ord").select("chrom", "pos", "ord")


@query("f13_mod_conflict", "variants", "sv", sql="SELECT DISTINCT m.chrom, m.pos FROM variants m WHERE m.vtype = 2 AND NOT EXISTS (SELECT 1 FROM sv s WHERE s.chrom = m.chrom AND s.pos = m.pos)")
def _(v, s):
    return variants.without_conflicts(v.where("vtype = 2"), s).select("chrom", "pos").distinct()


@query("f15_homopolymer_pair", "variants")
def _(v):
    return variants.crowded_homopolymers(v.select("chrom", "pos", (F.col("pos") % 5).alias("run")))


@query("f18_distance_gate", "variants", sql="SELECT chrom, pos, coalesce(lead(pos) OVER (PARTITION BY chrom ORDER BY pos) - pos <= 1, false) AS visit FROM (SELECT DISTINCT chrom, pos FROM variants WHERE pos % 4 <> 0) t")
def _(v):
    w = Window.partitionBy("chrom").orderBy("pos")
    return v.where("pos % 4 <> 0").select("chrom", "pos").distinct().withColumn("visit", F.coalesce(F.lead("pos").over(w) - F.col("pos") <= 1, F.lit(False)))


_CALL = "CASE WHEN prob >= 204 THEN 'mod' WHEN prob <= 51 THEN 'unmod' ELSE 'noise' END"


@query("f19_threshold_case", "calls", sql=f"SELECT scan_ord, {_CALL} AS state FROM calls")
def _(c):
    return c.select("scan_ord", methyl.call(F.col("prob")).alias("state"))


@query("f20_code_filter", "calls", sql="SELECT chrom, pos, count(*) AS n FROM calls WHERE event_type IN ('click', 'view') GROUP BY chrom, pos")
def _(c):
    return c.where(F.col("event_type").isin("click", "view")).groupBy("chrom", "pos").agg(F.count("*").alias("n"))


@query("f21_type_guard", "calls", "obs", sql="SELECT c.scan_ord FROM calls c WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.vtype = 0 AND o.chrom = c.chrom AND o.pos = c.pos)")
def _(c, o):
    return variants.without_conflicts(c, o.where("vtype = 0")).select("scan_ord")


@query("f22_ref_sanity", "variants", sql="SELECT chrom, pos FROM variants WHERE regexp_matches(alt, '^[ACGTacgt]$')")
def _(v):
    return v.where(F.col("alt").rlike("^[ACGTacgt]$")).select("chrom", "pos")


# -- joins -------------------------------------------------------------------------------------------------------------
@query("j01_range_join", "aln", "variants", sql="SELECT a.chrom, a.read_id, v.pos FROM aln a JOIN variants v ON a.chrom = v.chrom AND v.pos BETWEEN a.start_pos AND a.end_pos")
def _(a, v):
    return ranges.point_join(a, v.select("chrom", "pos"), ["chrom"], "start_pos", "end_pos", "pos", 64).select("chrom", "read_id", "pos")


@query("j02_allele_resolution", "obs", "variants", sql="SELECT o.chrom, o.read_id, o.pos, CASE WHEN substring('ACGT', CAST((o.pos + o.allele) % 4 AS INT) + 1, 1) = v.ref THEN 0 WHEN substring('ACGT', CAST((o.pos + o.allele) % 4 AS INT) + 1, 1) = v.alt THEN 1 END AS shown FROM obs o JOIN variants v ON o.chrom = v.chrom AND o.pos = v.pos")
def _(o, v):
    base = F.substring(F.lit("ACGT"), ((F.col("pos") + F.col("allele")) % 4).cast("int") + 1, F.lit(1))
    return o.join(v.select("chrom", "pos", "ref", "alt"), ["chrom", "pos"]).select("chrom", "read_id", "pos", F.when(base == F.col("ref"), 0).when(base == F.col("alt"), 1).alias("shown"))


@query("j05_gap_first", "aln", "variants", sql="SELECT a.chrom, a.read_id, min(v.pos) AS pos FROM aln a JOIN variants v ON a.chrom = v.chrom AND v.pos BETWEEN a.start_pos AND a.end_pos GROUP BY a.chrom, a.read_id")
def _(a, v):
    return ranges.point_join(a, v.select("chrom", "pos"), ["chrom"], "start_pos", "end_pos", "pos", 64).groupBy("chrom", "read_id").agg(F.min("pos").alias("pos"))


@query("j07_sv_similarity", "sv", sql="SELECT ord, 10 * abs(abs(svlen) + 1 - ord % 400) < abs(svlen) + 1 AS near FROM sv")
def _(s):
    return s.select("ord", (cigar.sv_similar(F.col("svlen"), F.col("ord") % 400) < 0.1).alias("near"))


@query("j08_read_mod_join", "obs", "calls", sql="SELECT o.chrom, o.read_id, o.pos, c.scan_ord, CASE WHEN c.prob >= 204 THEN 0 ELSE 1 END AS allele FROM obs o JOIN calls c ON o.chrom = c.chrom AND o.read_id = c.read_id AND o.read_id % 2 = c.strand")
def _(o, c):
    x = o.withColumn("strand", F.col("read_id") % 2).select("chrom", "read_id", "strand", "pos")
    return x.join(c.select("chrom", "read_id", "strand", "scan_ord", "prob"), ["chrom", "read_id", "strand"]).select("chrom", "read_id", "pos", "scan_ord", F.when(F.col("prob") >= 204, 0).otherwise(1).alias("allele"))


@query("j09_priority_union", "variants", "sv", sql="SELECT chrom, pos, min(prio) AS prio FROM (SELECT chrom, pos, CASE vtype WHEN 2 THEN 0 ELSE 2 END AS prio FROM variants UNION ALL SELECT chrom, pos, 1 AS prio FROM sv) t GROUP BY chrom, pos")
def _(v, s):
    u = v.select("chrom", "pos", F.when(F.col("vtype") == 2, 0).otherwise(2).alias("prio")).unionByName(s.select("chrom", "pos", F.lit(1).alias("prio")))
    return u.groupBy("chrom", "pos").agg(F.min("prio").alias("prio"))


@query("j11_asof_forward", "aln", "sv", sql="SELECT a.chrom, a.read_id, (SELECT min(s.pos) FROM sv s WHERE s.chrom = a.chrom AND s.pos >= a.start_pos) AS sv_pos FROM aln a")
def _(a, s):
    return ranges.asof_forward(a.select("chrom", "read_id", "start_pos"), s.select("chrom", F.col("pos").alias("sv_pos")), ["chrom"], "start_pos", "sv_pos").select("chrom", "read_id", "sv_pos")


@query("j12_read_extra_votes", "obs", "assigned", "calls", sql="""
    , v AS (SELECT o.chrom, o.read_id, sum(CASE WHEN (o.allele = 0 AND a.hp = 1) OR (o.allele = 1 AND a.hp = 2) THEN 1 ELSE 0 END) AS h1, sum(CASE WHEN (o.allele = 0 AND a.hp = 2) OR (o.allele = 1 AND a.hp = 1) THEN 1 ELSE 0 END) AS h2
      FROM obs o JOIN assigned a ON o.chrom = a.chrom AND o.pos = a.pos GROUP BY o.chrom, o.read_id),
    e AS (SELECT read_id, sum(CASE WHEN strand = 0 THEN 1 ELSE 0 END) AS x1, sum(CASE WHEN strand = 1 THEN 1 ELSE 0 END) AS x2 FROM calls WHERE prob >= 204 GROUP BY read_id)
    SELECT v.chrom, v.read_id, CAST(h1 + coalesce(x1, 0) AS BIGINT) AS h1, CAST(h2 + coalesce(x2, 0) AS BIGINT) AS h2 FROM v LEFT JOIN e ON v.read_id = e.read_id""")
def _(o, a, c):
    x = c.where("prob >= 204").select("read_id", F.when(F.col("strand") == 0, 1).otherwise(0).alias("h1"), F.when(F.col("strand") == 1, 1).otherwise(0).alias("h2"))
    return tag.with_extra(tag.votes(o, a), x).select("chrom", "read_id", "h1", "h2")


@query("j15_read_self_join", "obs", sql="""
    , r AS (SELECT *, row_number() OVER (PARTITION BY chrom, read_id ORDER BY pos, vtype, allele, qual) AS rn FROM obs)
    SELECT a.chrom, a.read_id, a.pos AS p1, b.pos AS p2, a.allele AS allele1, b.allele AS allele2 FROM r a JOIN r b ON a.chrom = b.chrom AND a.read_id = b.read_id AND b.rn > a.rn AND b.rn <= a.rn + 3""")
def _(o):
    return edges.following(o, 3).select("chrom", "read_id", "p1", "p2", "allele1", "allele2")


@query("j17_strand_self_join", "calls", sql="SELECT DISTINCT p.chrom, p.pos FROM calls p JOIN calls m ON p.chrom = m.chrom AND m.pos = p.pos + 1 WHERE p.strand = 0 AND m.strand = 1")
def _(c):
    plus = c.where("strand = 0").select("chrom", "pos").distinct()
    minus = c.where("strand = 1").select("chrom", (F.col("pos") - 1).alias("pos")).distinct()
    return plus.join(minus, ["chrom", "pos"])


@query("j18_interval_contain", "variants", "intervals", sql="SELECT v.chrom, v.pos, count(*) AS n FROM variants v JOIN intervals i ON v.chrom = i.chrom AND v.pos BETWEEN i.start_pos AND i.end_pos GROUP BY v.chrom, v.pos")
def _(v, i):
    return ranges.point_join(i, v.select("chrom", "pos"), ["chrom"], "start_pos", "end_pos", "pos", 256).groupBy("chrom", "pos").agg(F.count("*").alias("n"))


@query("j19_result_to_lines", "vcf", "assigned", sql="SELECT v.chrom, v.pos, CASE WHEN a.hp = 1 THEN '0|1' WHEN a.hp = 2 THEN '1|0' END AS gt FROM vcf v LEFT JOIN (SELECT * FROM assigned WHERE pos % 3 <> 0) a ON v.chrom = a.chrom AND v.pos = a.pos")
def _(v, a):
    return v.join(a.where("pos % 3 <> 0"), ["chrom", "pos"], "left").select("chrom", "pos", F.when(F.col("hp") == 1, "0|1").when(F.col("hp") == 2, "1|0").alias("gt"))


_MERGE = "FROM (SELECT * FROM variants WHERE pos % 3 <> 0) a FULL OUTER JOIN (SELECT * FROM variants WHERE pos % 2 = 0) b ON a.chrom = b.chrom AND a.pos = b.pos AND a.ref = b.ref AND a.alt = b.alt"


@query("j20_full_outer_merge", "variants", sql=f"SELECT coalesce(a.chrom, b.chrom) AS chrom, coalesce(a.pos, b.pos) AS pos, a.gt AS gt_a, b.gt AS gt_b {_MERGE}")
def _(v):
    side = lambda c, s: v.where(c).select("chrom", "pos", "ref", "alt", F.col("gt").alias(f"gt_{s}"))
    return side("pos % 3 <> 0", "a").join(side("pos % 2 = 0", "b"), ["chrom", "pos", "ref", "alt"], "full").select("chrom", "pos", "gt_a", "gt_b")


@query("j21_overlap_join", "intervals", sql="SELECT a.chrom, a.iv AS iv_a, b.iv AS iv_b FROM intervals a JOIN intervals b ON a.chrom = b.chrom AND a.start_pos <= b.end_pos AND b.start_pos <= a.end_pos")
def _(i):
    a = i.select("chrom", F.col("iv").alias("iv_a"), F.col("start_pos").alias("s1"), F.col("end_pos").alias("e1"))
    b = i.select("chrom", F.col("iv").alias("iv_b"), F.col("start_pos").alias("s2"), F.col("end_pos").alias("e2"))
    return ranges.overlap_join(a, b, ["chrom"], ("s1", "e1"), ("s2", "e2"), 256).select("chrom", "iv_a", "iv_b")


@query("j22_region_exclude", "variants", "intervals", sql="SELECT v.chrom, v.pos FROM variants v WHERE NOT EXISTS (SELECT 1 FROM intervals i WHERE v.chrom = i.chrom AND v.pos BETWEEN i.start_pos AND i.end_pos)")
def _(v, i):
    return ranges.points_within(v, i, ["chrom"], "start_pos", "end_pos", "pos", 256, anti=True).select("chrom", "pos")


@query("j23_multi_region_once", "aln", "intervals", sql="SELECT a.chrom, a.read_id FROM aln a WHERE EXISTS (SELECT 1 FROM intervals i WHERE a.chrom = i.chrom AND a.start_pos <= i.end_pos AND i.start_pos <= a.end_pos)")
def _(a, i):
    x = ranges.overlap_join(a.select("chrom", "read_id", "start_pos", "end_pos"), i.select("chrom", F.col("start_pos").alias("s"), F.col("end_pos").alias("e")), ["chrom"], ("start_pos", "end_pos"), ("s", "e"), 256)
    return x.select("chrom", "read_id").distinct()


# -- aggregates --------------------------------------------------------------------------------------------------------
_EDGES = """
    , r AS (SELECT *, row_number() OVER (PARTITION BY chrom, read_id ORDER BY pos, vtype, allele, qual) AS rn FROM obs),
    e AS (SELECT a.chrom, a.pos AS p1, b.pos AS p2, """ + ", ".join(
    f"CAST(sum(CASE WHEN a.allele = {x} AND b.allele = {y} AND {'' if h == 'hi' else 'NOT '}(a.qual >= 12 AND b.qual >= 12) THEN 1 ELSE 0 END) AS BIGINT) AS {n}_{h}"
    for n, (x, y) in {"rr": (0, 0), "ra": (0, 1), "ar": (1, 0), "aa": (1, 1)}.items() for h in ("hi", "lo")
) + """
      FROM r a JOIN r b ON a.chrom = b.chrom AND a.read_id = b.read_id AND b.rn > a.rn AND b.rn <= a.rn + 35 WHERE a.pos < b.pos GROUP BY a.chrom, a.pos, b.pos)"""  # fmt: skip


@query("a01_edge_weights", "obs", sql=f"{_EDGES} SELECT * FROM e")
def _(o):
    return edges.edge_weights(o)


@query("a02_para_cross", "obs", sql=f"{_EDGES} SELECT chrom, p1, p2, rr_hi + aa_hi AS para_hi, rr_lo + aa_lo AS para_lo, ra_hi + ar_hi AS cross_hi, ra_lo + ar_lo AS cross_lo FROM e")
def _(o):
    e, s = edges.edge_weights(o), lambda a, b, h: (F.col(f"{a}_{h}") + F.col(f"{b}_{h}"))
    return e.select("chrom", "p1", "p2", *[s(*x, h).alias(f"{n}_{h}") for n, x in (("para", ("rr", "aa")), ("cross", ("ra", "ar"))) for h in ("hi", "lo")])


@query("a03_node_reads", "obs", sql="SELECT chrom, pos, count(DISTINCT read_id) AS n_reads FROM obs GROUP BY chrom, pos")
def _(o):
    return o.groupBy("chrom", "pos").agg(F.count_distinct("read_id").alias("n_reads"))


@query("a04_clip_histogram", "cigars", sql="SELECT chrom, pos, sum(CASE WHEN aln_id % 7 > 5 THEN 1 ELSE 0 END) AS front, CAST(0 AS BIGINT) AS back FROM cigars WHERE aln_id % 7 > 5 GROUP BY chrom, pos")
def _(c):
    return cigar.clip_histogram(c)


_IV = "(SELECT DISTINCT chrom, start_pos, end_pos FROM intervals WHERE iv % 3 = 0)"
_MISS = f"""
    , x AS (SELECT i.chrom, i.start_pos, i.end_pos, o.read_id, o.pos, o.allele FROM {_IV} i JOIN obs o ON o.chrom = i.chrom AND o.pos BETWEEN i.start_pos AND i.end_pos),
    n AS (SELECT chrom, start_pos, end_pos, read_id, sum(allele) AS n_alt FROM x GROUP BY chrom, start_pos, end_pos, read_id HAVING sum(allele) > 0),
    m AS (SELECT x.chrom, x.pos, sum(CASE WHEN allele = 0 THEN n_alt END) AS ref_sum, count(CASE WHEN allele = 0 THEN n_alt END) AS ref_n, sum(CASE WHEN allele = 1 THEN n_alt END) AS alt_sum, count(CASE WHEN allele = 1 THEN n_alt END) AS alt_n
      FROM x JOIN n ON x.chrom = n.chrom AND x.start_pos = n.start_pos AND x.end_pos = n.end_pos AND x.read_id = n.read_id GROUP BY x.chrom, x.pos HAVING count(CASE WHEN allele = 0 THEN n_alt END) > 0 AND count(CASE WHEN allele = 1 THEN n_alt END) > 0)"""


def _intervals(i: DataFrame) -> DataFrame:
    return i.where("iv % 3 = 0").select("chrom", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"))


@query("a07_miss_rate", "obs", "intervals", sql=f"{_MISS} SELECT chrom, pos, CAST(ref_sum AS BIGINT) AS ref_sum, ref_n, CAST(alt_sum AS BIGINT) AS alt_sum, alt_n FROM m")
def _(o, i):
    return cnv.miss_rates(o, _intervals(i), 256).drop("miss_rate")


@query("f17_cnv_filter", "obs", "intervals", sql=f"{_MISS} SELECT o.chrom, o.read_id, o.pos FROM obs o WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.chrom = o.chrom AND m.pos = o.pos AND (alt_sum * 1.0 / alt_n) / (ref_sum * 1.0 / ref_n + alt_sum * 1.0 / alt_n) >= 0.55)")
def _(o, i):
    return cnv.without_misses(o, cnv.miss_rates(o, _intervals(i), 256), 0.55).select("chrom", "read_id", "pos")


_VOTES = """
    , v AS (SELECT o.chrom, o.read_id, """ + ", ".join(
    f"CAST(sum(CASE WHEN (CASE WHEN o.allele = 0 THEN a.hp ELSE 3 - a.hp END) = {h} AND {'o.vtype <= 1' if k == 'hi' else 'o.vtype > 1'} THEN 1 ELSE 0 END) AS BIGINT) AS h{h}_{k}" for h in (1, 2) for k in ("hi", "lo")
) + """ FROM obs o JOIN assigned a ON o.chrom = a.chrom AND o.pos = a.pos WHERE o.vtype <> 2 GROUP BY o.chrom, o.read_id),
    w AS (SELECT *, 10 * h1_hi + h1_lo AS s1, 10 * h2_hi + h2_lo AS s2 FROM v),
    c AS (SELECT *, CASE WHEN s1 > s2 THEN 1 WHEN s1 < s2 THEN 2 ELSE 0 END AS hp, s1 <> s2 AND greatest(s1, s2) * 100 > 65 * (s1 + s2) AND s1 + s2 > 10 AS confident FROM w),
    n AS (SELECT o.chrom, o.pos, """ + ", ".join(
    f"CAST(sum(CASE WHEN c.hp = {h} AND o.allele = {a} THEN 1 ELSE 0 END) AS BIGINT) AS hp{h}_{'alt' if a else 'ref'}" for h in (1, 2) for a in (0, 1)
) + """ FROM obs o JOIN c ON o.chrom = c.chrom AND o.read_id = c.read_id WHERE c.confident GROUP BY o.chrom, o.pos),
    z AS (SELECT chrom, pos, hp1_ref + hp2_alt AS r1, hp2_ref + hp1_alt AS r2 FROM n),
    g AS (SELECT chrom, pos, r1, r2, CASE WHEN r1 > r2 THEN 1 ELSE 2 END AS hp FROM z WHERE greatest(r1, r2) * 100 > 75 * (r1 + r2))"""  # fmt: skip


@query("a08_read_vote", "obs", "assigned", sql=f"{_VOTES} SELECT chrom, read_id, h1_hi, h1_lo, h2_hi, h2_lo, hp, confident FROM c")
def _(o, a):
    return correct.read_votes(o, a)


@query("a09_haplotype_counts", "obs", "assigned", sql=f"{_VOTES} SELECT * FROM n")
def _(o, a):
    return correct.haplotype_counts(o, correct.read_votes(o, a))


@query("a10_reassign", "obs", "assigned", sql=f"{_VOTES} SELECT * FROM g")
def _(o, a):
    return correct.reassigned(correct.haplotype_counts(o, correct.read_votes(o, a)))


@query("g07_correction", "obs", "assigned", sql=f"{_VOTES} SELECT g.chrom, g.pos, a.ps, g.hp FROM g JOIN assigned a ON g.chrom = a.chrom AND g.pos = a.pos")
def _(o, a):
    return correct.corrected(o, a)


@query("g08_export", "obs", "assigned", sql=f"{_VOTES} SELECT g.chrom, g.pos, CASE WHEN g.hp = 1 THEN '0|1' ELSE '1|0' END AS gt, a.ps FROM g JOIN assigned a ON g.chrom = a.chrom AND g.pos = a.pos")
def _(o, a):
    return phase.export(correct.corrected(o, a))


_TAG = """
    , v AS (SELECT o.chrom, o.read_id, sum(CASE WHEN (o.allele = 0 AND a.hp = 1) OR (o.allele = 1 AND a.hp = 2) THEN 1 ELSE 0 END) AS h1,
             sum(CASE WHEN (o.allele = 0 AND a.hp = 2) OR (o.allele = 1 AND a.hp = 1) THEN 1 ELSE 0 END) AS h2, count(DISTINCT a.ps) AS n_ps, min(a.ps) AS ps, count(*) AS total
      FROM obs o JOIN assigned a ON o.chrom = a.chrom AND o.pos = a.pos GROUP BY o.chrom, o.read_id)"""


@query("a12_hap_vote", "obs", "assigned", sql=f"{_TAG} SELECT chrom, read_id, CAST(h1 AS BIGINT) AS h1, CAST(h2 AS BIGINT) AS h2, total FROM v")
def _(o, a):
    return tag.votes(o, a).select("chrom", "read_id", "h1", "h2", "total")


@query("a13_cross_block", "obs", "assigned", sql=f"{_TAG} SELECT chrom, read_id, n_ps FROM v WHERE n_ps > 1")
def _(o, a):
    return tag.votes(o, a).where("n_ps > 1").select("chrom", "read_id", "n_ps")


@query("x13_pq", "obs", "assigned", sql=f"{_TAG} SELECT chrom, read_id, CASE WHEN greatest(h1, h2) = 0 THEN 0 WHEN least(h1, h2) = 0 THEN 40 ELSE CAST(floor(round(-10 * log10(least(h1, h2) * 1.0 / (h1 + h2)), 9)) AS INT) END AS pq FROM v")
def _(o, a):
    return tag.votes(o, a).select("chrom", "read_id", tag.phasing_quality(F.col("h1"), F.col("h2")).alias("pq"))


@query("x14_tag_decision", "obs", "assigned", sql=f"{_TAG} SELECT chrom, read_id, CASE WHEN greatest(h1, h2) * 10 < 6 * (h1 + h2) OR n_ps > 1 OR h1 = h2 THEN 0 WHEN h1 > h2 THEN 1 ELSE 2 END AS hp FROM v")
def _(o, a):
    return tag.judged(tag.votes(o, a)).select("chrom", "read_id", "hp")


_SITES = f", s AS (SELECT chrom, pos, max(strand) AS strand, CAST(sum(CASE WHEN {_CALL} = 'mod' THEN 1 ELSE 0 END) AS BIGINT) AS n_mod, CAST(sum(CASE WHEN {_CALL} = 'unmod' THEN 1 ELSE 0 END) AS BIGINT) AS n_unmod, CAST(sum(CASE WHEN {_CALL} = 'noise' THEN 1 ELSE 0 END) AS BIGINT) AS n_noise, count(*) AS depth FROM calls GROUP BY chrom, pos)"
_GT = "CASE WHEN greatest(n_mod, n_unmod) = 0 THEN NULL WHEN least(n_mod, n_unmod) * 10 >= 6 * greatest(n_mod, n_unmod) AND (depth - n_mod - n_unmod) * 10 <= 2 * depth THEN '0/1' WHEN n_mod >= n_unmod THEN '1/1' ELSE '0/0' END"


def _sites(c: DataFrame) -> DataFrame:
    calls = c.withColumn("call", methyl.call(F.col("prob"))).withColumn("read_name", F.col("read_id").cast("string"))
    s = methyl.site_counts(calls)
    return s.withColumn("depth", F.col("n_mod") + F.col("n_unmod") + F.col("n_noise")).withColumn("strand", F.col("pos") % 2)


@query("a14_site_counts", "calls", sql=f"{_SITES} SELECT chrom, pos, n_mod, n_unmod, n_noise FROM s")
def _(c):
    return _sites(c).select("chrom", "pos", "n_mod", "n_unmod", "n_noise")


@query("a15_genotype", "calls", sql=f"{_SITES} SELECT chrom, pos, {_GT} AS gt FROM s")
def _(c):
    return _sites(c).select("chrom", "pos", methyl.genotype(F.col("n_mod"), F.col("n_unmod"), F.col("depth")).alias("gt"))


@query("a16_strand_pair_gt", "calls", sql=f"{_SITES}, p AS (SELECT a.chrom, a.pos, a.n_mod + b.n_mod AS n_mod, a.n_unmod + b.n_unmod AS n_unmod, a.depth + b.depth AS depth FROM s a JOIN s b ON a.chrom = b.chrom AND b.pos = a.pos + 1 WHERE a.strand = 0 AND b.strand = 1), q AS (SELECT chrom, pos, n_mod, n_unmod, depth, {_GT} AS gt FROM p) SELECT * FROM q WHERE gt IS NOT NULL")
def _(c):
    return methyl.strand_pairs(_sites(c))


@query("f23_final_het", "calls", sql=f"{_SITES} SELECT chrom, pos FROM s WHERE {_GT} = '0/1'")
def _(c):
    return _sites(c).where(methyl.genotype(F.col("n_mod"), F.col("n_unmod"), F.col("depth")) == "0/1").select("chrom", "pos")


@query("a17_node_type", "obs", sql="SELECT chrom, pos, vtype FROM (SELECT chrom, pos, vtype, row_number() OVER (PARTITION BY chrom, pos ORDER BY CAST(read_id AS VARCHAR)) AS rn FROM obs) t WHERE rn = 1")
def _(o):
    return o.groupBy("chrom", "pos").agg(F.min_by("vtype", F.col("read_id").cast("string")).alias("vtype"))


@query("a19_last_variant", "variants", sql="SELECT chrom, max(pos) AS last_pos FROM variants GROUP BY chrom")
def _(v):
    return v.groupBy("chrom").agg(F.max("pos").alias("last_pos"))


@query("a20_counters", "aln", "variants", sql=f", r AS (SELECT {_ROUTE} AS route, read_id % 3 AS hp FROM aln LEFT JOIN (SELECT chrom AS c, max(pos) - 40 AS last_pos FROM variants WHERE chrom < 2 GROUP BY chrom) l ON chrom = c) SELECT count(*) AS total, count(CASE WHEN route = 'supplementary' THEN 1 END) AS supplementary, count(CASE WHEN route = 'secondary' THEN 1 END) AS secondary, count(CASE WHEN route = 'unmapped' THEN 1 END) AS unmapped, count(CASE WHEN route = 'judge' AND hp > 0 THEN 1 END) AS tagged, count(*) - count(CASE WHEN route = 'judge' AND hp > 0 THEN 1 END) AS untagged FROM r")
def _(a, v):
    return tag.counters(_routed(a, v).withColumn("hp", F.col("read_id") % 3))


@query("a22_allele_counts", "variants", sql="SELECT chrom, pos, CASE WHEN gt IN ('0/1', '1|0') THEN 1 ELSE 0 END AS n_ref, CASE WHEN gt = '1/1' THEN 2 ELSE 1 END AS n_alt FROM variants")
def _(v):
    n = strings.allele_counts(F.col("gt"), 2)
    return v.select("chrom", "pos", n[0].alias("n_ref"), n[1].alias("n_alt"))


# -- windows, sets -----------------------------------------------------------------------------------------------------
@query("w01_lead_gate", "variants", sql="SELECT chrom, pos, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS next_pos FROM variants")
def _(v):
    return v.select("chrom", "pos", F.lead("pos").over(Window.partitionBy("chrom").orderBy("pos")).alias("next_pos"))


@query("w02_node_rank", "variants", sql="SELECT chrom, pos, row_number() OVER (PARTITION BY chrom ORDER BY pos) AS node_rank FROM variants")
def _(v):
    return v.select("chrom", "pos", F.row_number().over(Window.partitionBy("chrom").orderBy("pos")).cast("long").alias("node_rank"))


@query("w03_next_n", "obs", sql="SELECT chrom, read_id, pos, count(*) OVER (PARTITION BY chrom, read_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 35 FOLLOWING) AS n_next FROM obs")
def _(o):
    w = Window.partitionBy("chrom", "read_id").orderBy("pos").rowsBetween(1, 35)
    return o.select("chrom", "read_id", "pos", F.count("*").over(w).alias("n_next"))


_OPS = """, k AS (SELECT aln_id, pos, unnest(regexp_extract_all(cigar, '([0-9]+)[A-Z=]', 1)) AS n, unnest(regexp_extract_all(cigar, '[0-9]+([A-Z=])', 1)) AS op, generate_subscripts(regexp_extract_all(cigar, '([0-9]+)[A-Z=]', 1), 1) - 1 AS op_index FROM cigars)"""


@query("w04_cigar_prefix", "cigars", sql=f"{_OPS} SELECT aln_id, op_index, op, CAST(n AS BIGINT) AS len, pos + coalesce(sum(CASE WHEN op IN ('M','=','X','D','N') THEN CAST(n AS BIGINT) ELSE 0 END) OVER w, 0) AS ref_start, CAST(coalesce(sum(CASE WHEN op IN ('M','=','X','I','S') THEN CAST(n AS BIGINT) ELSE 0 END) OVER w, 0) AS BIGINT) AS query_start FROM k WINDOW w AS (PARTITION BY aln_id ORDER BY op_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def _(c):
    return cigar.blocks(c, ["aln_id"]).select("aln_id", F.col("op_index").cast("long").alias("op_index"), "op", "len", "ref_start", "query_start")


@query("w05_depth_sweep", "aln", sql=", d AS (SELECT chrom, strand, pos, sum(d) AS d FROM (SELECT chrom, strand, start_pos AS pos, 1 AS d FROM aln UNION ALL SELECT chrom, strand, end_pos + 1, -1 FROM aln) t GROUP BY chrom, strand, pos) SELECT chrom, strand, pos, CAST(sum(d) OVER (PARTITION BY chrom, strand ORDER BY pos) AS BIGINT) AS depth FROM d")
def _(a):
    return depth.depth_sweep(a.withColumn("e", F.col("end_pos") + 1), ["chrom", "strand"], "start_pos", "e")


@query("w06_run_island", "calls", sql=", p AS (SELECT DISTINCT chrom, pos FROM calls), g AS (SELECT *, pos - row_number() OVER (PARTITION BY chrom ORDER BY pos) AS k FROM p) SELECT chrom, pos, min(pos) OVER (PARTITION BY chrom, k) AS representative FROM g")
def _(c):
    return ranges.runs(c.select("chrom", "pos").distinct(), ["chrom"], "pos")


@query(
    "w08_overlap_resolve", "obs",
    sql="""SELECT * FROM (WITH RECURSIVE a AS (SELECT chrom, read_id AS aln_id, read_id - read_id % 36 + read_id % 3 AS read_id, min(pos) AS f, max(pos) AS l FROM obs GROUP BY ALL),
    r AS (SELECT chrom, read_id, list(aln_id ORDER BY aln_id) AS id, list(f ORDER BY aln_id) AS f, list(l ORDER BY aln_id) AS l FROM a GROUP BY chrom, read_id),
    w AS (SELECT chrom, read_id, CAST(1 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept, CAST(-1 AS BIGINT) AS e FROM r
      UNION ALL SELECT chrom, read_id, CASE WHEN fate = 'pop' THEN k ELSE k + 1 END, CASE fate WHEN 'stay' THEN list_append(kept, k) WHEN 'pop' THEN kept[:-2] ELSE kept END, CASE WHEN fate <> 'pop' THEN l[k] WHEN len(kept) > 1 THEN l[kept[-2]] ELSE -1 END
      FROM (SELECT *, CASE WHEN t IS NULL OR f[k] > e THEN 'stay' WHEN l[k] < e THEN 'go' WHEN least(l[t], l[k]) - greatest(f[t], f[k]) + 1 <= 0 OR (least(l[t], l[k]) - greatest(f[t], f[k]) + 1) / (greatest(l[t], l[k]) - least(f[t], f[k]) + 1) < 0.2 THEN 'stay' WHEN l[k] - f[k] <= l[t] - f[t] THEN 'go' ELSE 'pop' END AS fate
        FROM (SELECT w.*, r.f, r.l, kept[-1] AS t FROM w JOIN r USING (chrom, read_id) WHERE k <= len(r.id)) x) y)
    SELECT w.chrom, id[unnest(kept)] AS aln_id FROM w JOIN r USING (chrom, read_id) WHERE k > len(id)) z""",
)
def _(o):
    x = o.withColumn("aln_id", F.col("read_id")).withColumn("read_id", F.col("read_id").cast("long") - F.col("read_id") % 36 + F.col("read_id") % 3)
    return overlap.without_overlaps(x).select("chrom", "aln_id").distinct()


@query(
    "w09_cnv_machine", "aln",
    sql="""SELECT * FROM (WITH RECURSIVE h AS (SELECT chrom, pos, sum(u) AS u, sum(d) AS d FROM (SELECT chrom, start_pos * 50 AS pos, 1 AS u, 0 AS d FROM aln UNION ALL SELECT chrom, end_pos * 50 + 7, 0, 1 FROM aln) x GROUP BY chrom, pos),
    g AS (SELECT chrom, CAST(pos AS BIGINT) AS pos, CAST(u AS BIGINT) AS u, CAST(d AS BIGINT) AS d, row_number() OVER (PARTITION BY chrom ORDER BY pos) AS k FROM (SELECT * FROM h UNION ALL SELECT chrom, max(pos) + 30000, arg_max(u, pos), arg_max(d, pos) FROM h GROUP BY chrom) y),
    w AS (SELECT chrom, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS s, CAST(NULL AS BIGINT) AS e, CAST(0 AS BIGINT) AS b, CAST(NULL AS BIGINT) AS p, CAST(NULL AS BIGINT) AS f, CAST(NULL AS BIGINT) AS t FROM (SELECT DISTINCT chrom FROM g) c
      UNION ALL SELECT chrom, k, CASE WHEN NOT over THEN s END, CASE WHEN NOT over THEN e END, b, CASE WHEN NOT over THEN p END, CASE WHEN shut THEN s END, CASE WHEN shut THEN pos END
      FROM (SELECT *, coalesce(s IS NOT NULL AND NOT fresh AND (shut OR pos > e OR b <= 0 OR pos - s >= 200000), false) AS over
        FROM (SELECT chrom, k, pos, s, b, p, fresh, CASE WHEN NOT fresh AND b > 30 THEN pos + 30000 ELSE e END AS e,
            coalesce(s IS NOT NULL AND NOT fresh AND CASE WHEN p IS NULL THEN slow ELSE d >= CASE WHEN p < 10 THEN 5 ELSE p // 2 END OR (b <= CASE WHEN p < 10 THEN 2 WHEN p < 20 THEN p // 4 ELSE 5 END AND pos <= CASE WHEN b > 30 THEN pos ELSE e END) END, false) AS shut
          FROM (SELECT chrom, gk AS k, pos, d, slow, fresh, CASE WHEN fresh THEN CASE WHEN u >= 5 OR u > d THEN pos END WHEN u > p THEN pos ELSE s END AS s, CASE WHEN fresh OR u > p THEN pos + 30000 ELSE e END AS e,
              CASE WHEN fresh THEN u - d ELSE b + u - d END AS b, CASE WHEN fresh THEN CASE WHEN u >= 5 THEN u END WHEN u > p THEN u ELSE p END AS p
            FROM (SELECT w.*, d >= CASE WHEN b > 20 THEN b // 4 ELSE 5 END AS slow, s IS NULL OR (p IS NULL AND u >= 5 AND d < CASE WHEN b > 20 THEN b // 4 ELSE 5 END) AS fresh, g.pos, g.u, g.d, g.k AS gk FROM w JOIN g ON g.chrom = w.chrom AND g.k = w.k + 1) a) c) d2) e2)
    SELECT chrom, f AS "start", t AS "end" FROM w WHERE f IS NOT NULL) z""",
)
def _(a):
    ends = a.select("chrom", F.explode(F.array(F.struct((F.col("start_pos") * 50).alias("pos"), F.lit(1).alias("front"), F.lit(0).alias("back")), F.struct((F.col("end_pos") * 50 + 7).alias("pos"), F.lit(0).alias("front"), F.lit(1).alias("back")))).alias("x"))
    return cnv.cnv_intervals(ends.groupBy("chrom", "x.pos").agg(F.sum("x.front").alias("front"), F.sum("x.back").alias("back")))


@query("o07_argmax", "obs", "assigned", sql=f"{_TAG} SELECT chrom, read_id, CASE WHEN h1 > h2 THEN 1 WHEN h2 > h1 THEN 2 ELSE 0 END AS best FROM v")
def _(o, a):
    return tag.votes(o, a).select("chrom", "read_id", F.when(F.col("h1") > F.col("h2"), 1).when(F.col("h2") > F.col("h1"), 2).otherwise(0).alias("best"))


@query("u01_union_files", "obs", sql="SELECT chrom, read_id, pos, 0 AS file_ord FROM obs WHERE read_id % 2 = 0 UNION ALL SELECT chrom, read_id, pos, 1 FROM obs WHERE read_id % 2 = 1")
def _(o):
    part = lambda k: o.where(f"read_id % 2 = {k}").select("chrom", "read_id", "pos", F.lit(k).alias("file_ord"))
    return part(0).unionByName(part(1))


@query("u03_pos_union", "calls", sql="SELECT chrom, pos FROM calls WHERE strand = 0 UNION SELECT chrom, pos + 1 FROM calls WHERE strand = 0")
def _(c):
    p = c.where("strand = 0")
    return p.select("chrom", "pos").union(p.select("chrom", F.col("pos") + 1)).distinct()


@query("u04_merge_intervals", "intervals", sql=", m AS (SELECT *, max(end_pos) OVER (PARTITION BY chrom ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM intervals), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_pos > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM m) SELECT chrom, min(start_pos) AS start_pos, max(end_pos) AS end_pos, count(*) AS n FROM g GROUP BY chrom, k")
def _(i):
    return ranges.merge_intervals(i, ["chrom"], "start_pos", "end_pos")


@query("u05_presence_mask", "variants", sql=f"SELECT coalesce(a.chrom, b.chrom) AS chrom, coalesce(a.pos, b.pos) AS pos, CASE WHEN a.pos IS NULL THEN 0 ELSE 1 END + CASE WHEN b.pos IS NULL THEN 0 ELSE 2 END AS has_line {_MERGE}")
def _(v):
    side = lambda c, k: v.where(c).select("chrom", "pos", F.lit(k).alias("bit"))
    return side("pos % 3 <> 0", 1).union(side("pos % 2 = 0", 2)).groupBy("chrom", "pos").agg(F.bit_or("bit").alias("has_line"))


# -- graph -------------------------------------------------------------------------------------------------------------
_G02 = f"""{_EDGES}, t AS (SELECT chrom, pos, min(vtype) AS vtype FROM obs GROUP BY chrom, pos),
    w AS (SELECT e.chrom, e.p1, e.p2, a.vtype AS t1, b.vtype AS t2, 10 * (rr_hi + aa_hi) + rr_lo + aa_lo AS para, 10 * (ra_hi + ar_hi) + ra_lo + ar_lo AS crs FROM e JOIN t a ON e.chrom = a.chrom AND e.p1 = a.pos JOIN t b ON e.chrom = b.chrom AND e.p2 = b.pos)
    SELECT chrom, p1, p2, CASE WHEN para = crs OR (CASE WHEN (t1 = 0 AND t2 = 2) OR (t1 = 2 AND t2 = 0) THEN para + crs < 10 OR least(para, crs) * 10 > 3 * greatest(para, crs) ELSE least(para, crs) * 10 > 7 * greatest(para, crs) END) THEN 0 WHEN para > crs THEN 1 ELSE -1 END AS decision,
      CASE WHEN (least(para, crs) * 10 <= greatest(para, crs) AND para + crs >= 10) OR ((para >= 10) <> (crs >= 10)) THEN 20 ELSE 1 END AS weight FROM w"""


@query("g02_edge_decision", "obs", sql=_G02)
def _(o):
    return edges.decided(edges.edge_weights(o), edges.node_types(o)).select("chrom", "p1", "p2", "decision", "weight")


@query("g05_greedy_phase", "obs_gapped")
def _(o):
    return phase.walked(o)


@query("g06_blocks", "obs_gapped")
def _(o):
    return phase.blocks(phase.walked(o, 10))


@query("g10_methylation_graph", "obs", sql=f"{_EDGES}, y AS (SELECT chrom, pos, vtype FROM (SELECT chrom, pos, vtype, row_number() OVER (PARTITION BY chrom, pos ORDER BY read_id) AS rn FROM obs) t WHERE rn = 1) SELECT e.chrom, p1, p2, rr_hi + rr_lo + aa_hi + aa_lo AS same, ra_hi + ra_lo + ar_hi + ar_lo AS flipped FROM e JOIN y a ON e.chrom = a.chrom AND p1 = a.pos JOIN y b ON e.chrom = b.chrom AND p2 = b.pos WHERE a.vtype <> 0 OR b.vtype <> 0")
def _(o):
    return methyl.graph(o)[1]


# Sites in SQL: firm pairs f, unbroken ways of a set of members m, and the flags of each pass as sets of sites.
_FIRM = _EDGES.replace("FROM obs)", "FROM obs_dense)") + """
    , n AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos) AS k FROM (SELECT chrom, pos, min_by(vtype, read_id) AS vtype, count(DISTINCT read_id) AS n FROM obs_dense GROUP BY chrom, pos) x),
    pr AS (SELECT e.chrom, p1, p2, a.vtype AS t1, b.vtype AS t2, a.k AS k1, b.k AS k2, a.n + b.n AS depths, rr_hi + rr_lo + aa_hi + aa_lo + ra_hi + ra_lo + ar_hi + ar_lo AS total, greatest(rr_hi + rr_lo + aa_hi + aa_lo, ra_hi + ra_lo + ar_hi + ar_lo) AS most
      FROM e JOIN n a ON a.chrom = e.chrom AND a.pos = p1 JOIN n b ON b.chrom = e.chrom AND b.pos = p2 WHERE a.vtype <> 0 OR b.vtype <> 0),
    f AS (SELECT *, most * 10 >= total * 9 AS sure FROM pr WHERE total > 6 AND total * 4 > depths),
    opens AS (SELECT DISTINCT chrom, p1 AS pos FROM pr)"""


def _way(name: str, members: str, added: str | None = None) -> str:
    """CTEs of the sure ends among members that meet the next 20, or the next added ones."""
    either = f"(SELECT count(*) FROM {added} d WHERE d.chrom = a.chrom AND d.pos > a.pos AND d.pos <= b.pos)" if added else "b.m - a.m"
    is_in = lambda x: f"EXISTS (SELECT 1 FROM {added} d WHERE d.chrom = {x}.chrom AND d.pos = {x}.pos)"
    place = f"CASE WHEN {is_in('a')} THEN b.m - a.m ELSE {either} END" if added else either
    return f""", {name}_m AS (SELECT chrom, pos, row_number() OVER (PARTITION BY chrom ORDER BY pos) AS m FROM {members}),
    {name}_p AS (SELECT f.chrom, p1, p2, sure, {place} AS place FROM f JOIN {name}_m a ON a.chrom = f.chrom AND a.pos = p1 JOIN {name}_m b ON b.chrom = f.chrom AND b.pos = p2 WHERE b.m - a.m <= 20 {f"AND ({is_in('a')} OR {is_in('b')})" if added else ""}),
    {name}_s AS (SELECT chrom, p1, p2 FROM (SELECT *, row_number() OVER (PARTITION BY chrom, p1 ORDER BY place) AS rn FROM {name}_p) x WHERE sure AND rn = place),
    {name} AS (SELECT chrom, p1 AS pos FROM {name}_s UNION SELECT chrom, p2 FROM {name}_s)"""


_NEIGHBOURS = """, z AS (SELECT l.chrom, l.pos, n.vtype, lag(l.pos) OVER w AS b, lead(l.pos) OVER w AS a FROM passed l JOIN n ON n.chrom = l.chrom AND n.pos = l.pos WINDOW w AS (PARTITION BY l.chrom ORDER BY l.pos)),
    holds AS (SELECT chrom, p1, p2 FROM pr WHERE total >= 6 AND most * 10 >= total * 9)
    SELECT chrom, pos FROM z WHERE vtype <> 0 AND (b IS NULL OR (a IS NULL AND EXISTS (SELECT 1 FROM opens o WHERE o.chrom = z.chrom AND o.pos = z.b))
      OR (EXISTS (SELECT 1 FROM holds h WHERE h.chrom = z.chrom AND p1 = z.b AND p2 = z.pos) AND EXISTS (SELECT 1 FROM holds h WHERE h.chrom = z.chrom AND p1 = z.pos AND p2 = z.a)))"""


def _round(k: int) -> str:
    """The k-th round: the sites that are new, and the weak ones of the next."""
    return _way(f"r{k}", f"weak{k}", f"added{k}") + f""", added{k + 1} AS (SELECT * FROM r{k} EXCEPT SELECT * FROM seen{k}), seen{k + 1} AS (SELECT * FROM seen{k} UNION SELECT * FROM added{k + 1}),
    weak{k + 1} AS (SELECT * FROM added{k + 1} UNION SELECT a.chrom, a.pos FROM r{k}_m a JOIN opens o ON o.chrom = a.chrom AND o.pos = a.pos WHERE NOT EXISTS (SELECT 1 FROM r{k}_m b WHERE b.chrom = a.chrom AND b.m > a.m AND b.m <= a.m + 20
      AND EXISTS (SELECT 1 FROM added{k} d WHERE d.chrom = a.chrom AND (d.pos = a.pos OR d.pos = b.pos))))"""


@query(
    "g11_strong_sites", "obs_dense",
    sql=_FIRM + """, way AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chrom, p1 ORDER BY k2) AS rn FROM f) x WHERE rn = k2 - k1),
    strong AS (SELECT chrom, p1 AS pos FROM way WHERE t1 = 2 AND t2 = 0 AND sure AND rn <= 20 UNION SELECT w.chrom, w.p2 FROM way w WHERE rn = 1 AND EXISTS (SELECT 1 FROM way v WHERE v.chrom = w.chrom AND v.p1 = w.p1 AND v.t1 = 0 AND v.t2 = 2 AND v.sure)),
    met AS (SELECT chrom, p1 AS pos FROM way WHERE t1 = 2 AND t2 = 0 AND rn <= 20 UNION SELECT chrom, p2 FROM way WHERE t1 = 0 AND t2 = 2),
    ways AS (SELECT o.*, n.vtype FROM opens o JOIN n ON n.chrom = o.chrom AND n.pos = o.pos)"""
    + _way("added0", "strong") + """, seen0 AS (SELECT chrom, pos FROM ways WHERE vtype = 0 UNION SELECT * FROM added0), weak0 AS ((SELECT chrom, pos FROM ways WHERE vtype = 2 EXCEPT SELECT * FROM met) UNION SELECT * FROM added0)"""
    + _round(0) + _round(1) + ", passed AS (SELECT * FROM seen2)" + _NEIGHBOURS,
)
def _(o):
    return methyl.connected(*methyl.graph(o))


@query("g15_no_snp_sites", "obs_dense", sql=_FIRM + ", strong AS (SELECT chrom, pos FROM n WHERE vtype = 2)" + _way("passed", "strong") + _NEIGHBOURS)
def _(o):
    return methyl.connected(*methyl.graph(o), with_snps=False)


@query("k06_dot_edges", "obs", sql=f"SELECT chrom, p1, p2, concat(p1 + 1, '.1 -> ', p2 + 1, CASE WHEN decision = 1 THEN '.1' ELSE '.2' END) AS line FROM ({_G02.replace(_EDGES, 'WITH obs AS (SELECT * FROM obs)' + _EDGES)}) q WHERE decision <> 0")
def _(o):
    return edges.dot_lines(edges.decided(edges.edge_weights(o), edges.node_types(o)))


@query("t01_pileup_depth", "aln", sql="SELECT chrom, p AS pos, count(*) AS depth FROM (SELECT chrom, unnest(generate_series(start_pos, end_pos)) AS p FROM aln) t GROUP BY chrom, p")
def _(a):
    return depth.pileup_depth(a, ["chrom"], "start_pos", "end_pos")


@query(
    "t02_pileup_files", "cigars",
    sql="""SELECT chrom, pos, count(*) FILTER (file = 0) AS depth0, count(*) FILTER (file = 1) AS depth1, coalesce(string_agg(cell, '' ORDER BY aln_id) FILTER (file = 0), '') AS text0, coalesce(string_agg(cell, '' ORDER BY aln_id) FILTER (file = 1), '') AS text1
    FROM (WITH r AS (SELECT *, aln_id % 2 AS file, aln_id % 7 AS a, 5 + aln_id % 30 AS b, 1 + aln_id % 4 AS c, 3 + aln_id % 9 AS d, 1 + aln_id % 5 AS e, 2 + aln_id % 6 AS f, substring(repeat('ACGTTGCA', 20), CAST(1 + aln_id % 4 AS INT), 100) AS seq FROM cigars WHERE flag & 4 = 0)
      SELECT chrom, file, aln_id, pos + k AS pos, CASE WHEN k = 0 THEN '^' || chr(CAST(33 + flag AS INT)) ELSE '' END || substring(seq, a + k + 1, 1) || CASE WHEN k = b - 1 THEN '+' || c || '(' || substring(seq, a + b + 1, c) || ')' ELSE '' END AS cell FROM (SELECT *, unnest(range(0, b)) AS k FROM r) m
      UNION ALL SELECT chrom, file, aln_id, pos + b + k, substring(seq, a + b + c + k + 1, 1) || CASE WHEN k = d - 1 THEN '-' || e || '()' ELSE '' END FROM (SELECT *, unnest(range(0, d)) AS k FROM r) m
      UNION ALL SELECT chrom, file, aln_id, pos + b + d + k, '*' FROM (SELECT *, unnest(range(0, e)) AS k FROM r) m
      UNION ALL SELECT chrom, file, aln_id, pos + b + d + e + k, substring(seq, a + b + c + d + k + 1, 1) || CASE WHEN k = f - 1 THEN '$' ELSE '' END FROM (SELECT *, unnest(range(0, f)) AS k FROM r) m) t GROUP BY chrom, pos""",
)
def _(c):
    size = cigar.query_length(F.col("cigar")).cast("int")
    reads = c.select("chrom", "aln_id", "pos", "flag", "cigar", F.col("flag").alias("mapq"), (F.col("aln_id") % 2).alias("file"), F.substring(F.repeat(F.lit("ACGTTGCA"), 20), (1 + F.col("aln_id") % 4).cast("int"), size).alias("seq"))
    x = pileup.columns(reads, 2)
    return x.select("chrom", "pos", *[F.col("depths")[k].alias(f"depth{k}") for k in (0, 1)], *[F.col("texts")[k].alias(f"text{k}") for k in (0, 1)])


@query(
    "t07_mapping_quality_cap", "cigars",
    sql="""SELECT aln_id, CAST(CASE WHEN t > 40 THEN -1 ELSE floor(sqrt((40 - greatest(t, 0)) / 40) * 40 + 0.499) END AS INT) AS cap FROM (SELECT aln_id, coalesce(sum(least(33, q)) FILTER (off), 0)
        - CASE WHEN count(*) FILTER (off) = 0 THEN 0 ELSE 4.343 * (count(*) FILTER (off) * ln(count(*) FILTER (good) + max(b + d + CASE WHEN aln_id % 3 = 0 THEN f ELSE 0 END)) - lgamma(count(*) FILTER (off) + 1)) END
        + max(coalesce(list_sum(list_transform(range(a), lambda k: (aln_id + 3 * k) % 41)), 0) + CASE WHEN aln_id % 3 = 0 THEN 13 * (1 + aln_id % 3) ELSE 0 END) / 5.0 AS t
      FROM (SELECT *, good AND substring(repeat('ACGTTGCA', 20), CAST(1 + aln_id % 4 + y AS INT), 1) <> base AS off FROM (SELECT *, (aln_id + 3 * y) % 41 AS q, substring(repeat('ACGTNGCA', 20), CAST(1 + x AS INT), 1) AS base, (aln_id + 3 * y) % 41 >= 13 AND substring(repeat('ACGTNGCA', 20), CAST(1 + x AS INT), 1) <> 'N' AS good
        FROM (SELECT *, CASE s WHEN 1 THEN k WHEN 2 THEN b + k ELSE b + d + e + k END AS x, CASE s WHEN 1 THEN a + k WHEN 2 THEN a + b + c + k ELSE a + b + c + d + k END AS y
          FROM (SELECT *, unnest(range(0, CASE s WHEN 1 THEN b WHEN 2 THEN d ELSE f - aln_id % 3 END)) AS k
            FROM (SELECT aln_id, aln_id % 7 AS a, 5 + aln_id % 30 AS b, 1 + aln_id % 4 AS c, 3 + aln_id % 9 AS d, 1 + aln_id % 5 AS e, 2 + aln_id % 6 AS f, unnest([1, 2, 3]) AS s FROM cigars) p0) p1) p2) p3) p4 GROUP BY aln_id) p5""",
)
def _(c):
    n, size = F.col("aln_id"), cigar.query_length(F.col("cigar")).cast("int")
    seq = F.substring(F.repeat(F.lit("ACGTTGCA"), 20), (1 + n % 4).cast("int"), size)
    qual = F.transform(F.sequence(F.lit(0), size - 1), lambda k: ((n + 3 * k) % 41).cast("int"))
    ref = F.substring(F.repeat(F.lit("ACGTNGCA"), 20), F.lit(1), (cigar.ref_length(F.col("cigar")) - n % 3).cast("int"))
    return c.select("aln_id", realign.mapping_quality_cap(F.col("cigar"), seq, qual, ref).alias("cap"))


@query(
    "t03_mate_overlaps", "@orders",
    sql="""WITH o AS (SELECT o_orderkey AS o, o_orderkey % 15 AS s, substring(md5(CAST(o_orderkey AS VARCHAR)), 1, 1) < '8' AS first FROM orders),
    a AS (SELECT o, k, k AS ref, (o + k // 3) % 4 AS base, (o * 7 + k * 3) % 41 AS q FROM (SELECT *, unnest(range(0, 20)) AS k FROM o) t),
    b AS (SELECT o, k, CASE WHEN k < 6 THEN s + k ELSE s + k + 2 END AS ref, (o + (s + k) // 3) % 4 AS base, (o * 5 + k * 11) % 41 AS q FROM (SELECT *, unnest(range(0, 16)) AS k FROM o) t),
    m AS (SELECT a.o, a.k AS ka, b.k AS kb, CASE WHEN a.base = b.base THEN first WHEN a.q = b.q THEN first ELSE a.q > b.q END AS won, CASE WHEN a.base = b.base THEN least(200, a.q + b.q) ELSE greatest(a.q, b.q) * 4 // 5 END AS kept FROM a JOIN b ON a.o = b.o AND a.ref = b.ref JOIN o ON o.o = a.o)
    SELECT a.o * 2 AS aln_id, string_agg(CAST(CASE WHEN m.o IS NULL THEN q WHEN won THEN kept ELSE 0 END AS VARCHAR), ',' ORDER BY k) AS quals FROM a LEFT JOIN m ON m.o = a.o AND m.ka = a.k GROUP BY a.o
    UNION ALL SELECT b.o * 2 + 1, string_agg(CAST(CASE WHEN m.o IS NULL THEN q WHEN won THEN 0 ELSE kept END AS VARCHAR), ',' ORDER BY k) FROM b LEFT JOIN m ON m.o = b.o AND m.kb = b.k GROUP BY b.o""",
)
def _(orders):
    o, s = F.col("o_orderkey"), F.col("o_orderkey") % 15
    bases = lambda start, n: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.substring(F.lit("ACGT"), ((o + F.floor((start + k) / 3)) % 4 + 1).cast("int"), F.lit(1))), "")
    quals = lambda x, y, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: ((o * x + k * y) % 41).cast("int"))
    row = lambda k, flag, pos, text, seq, qual: F.struct((o * 2 + k).alias("aln_id"), F.lit(flag).alias("flag"), pos.alias("pos"), F.lit(text).alias("cigar"), seq.alias("seq"), qual.alias("qual"))
    mates = F.array(row(0, 99, o, "20M", bases(F.lit(0), 20), quals(7, 3, 20)), row(1, 147, o + s, "6M2D10M", bases(s, 16), quals(5, 11, 16)))
    reads = orders.select((o % 3).alias("chrom"), o.cast("string").alias("qname"), F.explode(mates).alias("r")).select("chrom", "qname", "r.*")
    return pileup.overlaps_resolved(reads, []).select("aln_id", F.array_join(F.transform("qual", lambda q: q.cast("string")), ",").alias("quals"))


@query(
    "a24_genotype_likelihoods", "obs",
    sql="""SELECT chrom, pos, first, second, round(phred, 5) AS phred FROM (WITH b AS (SELECT chrom, pos, allele, least(greatest(qual, 4), 63) AS q, read_id % 2 AS s FROM obs),
    r AS (SELECT *, count(*) OVER (PARTITION BY chrom, pos) AS n, count(*) OVER o - 1 AS k, CASE WHEN s = 1 THEN sum(s) OVER o - 1 ELSE count(*) OVER o - 1 - sum(s) OVER o END AS w FROM b WINDOW o AS (PARTITION BY chrom, pos, allele ORDER BY q DESC, s DESC ROWS UNBOUNDED PRECEDING)),
    p AS (SELECT q, n, j, exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(pow(10, -q / 10.0)) + (n - j) * ln(1 - pow(10, -q / 10.0))) AS p FROM (SELECT q, n, unnest(range(0, n + 1)) AS j FROM (SELECT DISTINCT q, n FROM r) d) u),
    t AS (SELECT q, n, j, sum(p) OVER (PARTITION BY q, n ORDER BY j DESC) AS tail FROM p),
    c AS (SELECT x.q, x.n, x.j AS k, 10 / ln(10) * (ln(x.tail) - ln(y.tail)) AS c FROM t x JOIN t y ON x.q = y.q AND x.n = y.n AND y.j = x.j + 1),
    e AS (SELECT chrom, pos, coalesce(sum((pow(1 - 0.17, w) * 0.97 + 0.03) * c) FILTER (allele = 0), 0) AS e0, coalesce(sum((pow(1 - 0.17, w) * 0.97 + 0.03) * c) FILTER (allele = 1), 0) AS e1, count(*) FILTER (allele = 0) AS n0, count(*) FILTER (allele = 1) AS n1
      FROM r JOIN c ON c.q = r.q AND c.n = r.n AND c.k = r.k GROUP BY chrom, pos)
    SELECT chrom, pos, 0 AS first, 0 AS second, greatest(e1, 0) AS phred FROM e UNION ALL SELECT chrom, pos, 1, 1, greatest(e0, 0) FROM e
    UNION ALL SELECT chrom, pos, 0, 1, greatest(0, -4.343 * (CASE WHEN n0 > 0 AND n1 > 0 THEN lgamma(n0 + n1 + 1) - lgamma(n0 + 1) - lgamma(n1 + 1) ELSE 0 END - (n0 + n1) * ln(2))) FROM e) q""",
)
def _(o):
    sums = likelihood.allele_sums(o.withColumn("strand", F.col("read_id") % 2), ["chrom", "pos"])
    return likelihood.genotypes(sums, ["chrom", "pos"], [0, 1]).withColumn("phred", F.round("phred", 5))


@query(
    "g14_neighbours", "obs_dense",
    sql=f"""{_EDGES.replace("FROM obs)", "FROM obs_dense)")}, c AS (SELECT chrom, pos, lag(pos) OVER w AS b, lead(pos) OVER w AS a FROM (SELECT chrom, pos, min_by(vtype, read_id) AS vtype FROM obs_dense GROUP BY chrom, pos) x WHERE vtype = 2 WINDOW w AS (PARTITION BY chrom ORDER BY pos)),
    ok AS (SELECT chrom, p1, p2 FROM (SELECT chrom, p1, p2, rr_hi + rr_lo + aa_hi + aa_lo AS same, ra_hi + ra_lo + ar_hi + ar_lo AS flipped FROM e) y WHERE same + flipped >= 6 AND greatest(same, flipped) * 10 >= 9 * (same + flipped))
    SELECT c.chrom, c.pos FROM c WHERE b IS NULL OR a IS NULL OR (EXISTS (SELECT 1 FROM ok WHERE ok.chrom = c.chrom AND p1 = b AND p2 = pos) AND EXISTS (SELECT 1 FROM ok WHERE ok.chrom = c.chrom AND p1 = pos AND p2 = a))""",
)
def _(o):
    node, pairs = methyl.graph(o)
    return methyl.neighbours_agree(node.where("vtype = 2"), pairs)


@query(
    "s22_region_query", "aln", "intervals",
    sql="SELECT a.chrom, a.read_id, a.start_pos, a.end_pos FROM aln a WHERE EXISTS (SELECT 1 FROM intervals i WHERE a.chrom = i.chrom AND a.start_pos <= i.end_pos AND i.start_pos <= a.end_pos)",
)
def _(a, i):
    x = ranges.in_regions(a, i.select("chrom", F.col("start_pos").alias("start"), F.col("end_pos").alias("end")), ["chrom"], ("start_pos", "end_pos"), size=16)
    return x.select("chrom", "read_id", "start_pos", "end_pos")


# -- alignments as files -----------------------------------------------------------------------------------------------
def _bam_folder(c: DataFrame) -> str:
    """The alignments of the view, with sequences and tags, written as BAM files."""
    from strandloom.sources import bam_sink, shared

    size = cigar.query_length(F.col("cigar")).cast("int")
    seq = F.substring(F.repeat(F.lit("ACGTTGCA"), 20), (1 + F.col("aln_id") % 4).cast("int"), size)
    tags = F.create_map(F.lit("HP"), (F.col("aln_id") % 2 + 1).cast("string"), F.lit("PS"), F.col("pos").cast("string"))
    reads = c.select(
        F.concat(F.lit("r"), F.col("aln_id")).alias("qname"), F.col("flag").cast("int").alias("flag"), F.concat(F.lit("c"), F.col("chrom")).alias("rname"), "pos", F.lit(30).alias("mapq"), "cigar",
        F.lit("*").alias("rnext"), F.lit(-1).cast("long").alias("pnext"), F.lit(0).cast("long").alias("tlen"), seq.alias("seq"), F.lit("*").alias("qual"), tags.alias("tags"),
    )
    at = shared.new_folder(c.sparkSession, "bam")
    bam_sink.written(reads, at, bam_sink.header_of([(f"c{k}", 1 << 28) for k in range(3)]))
    return at


@query(
    "k07_bam_round_trip", "cigars",
    sql="""SELECT concat('r', aln_id) AS qname, flag, concat('c', chrom) AS rname, pos, cigar, substring(repeat('ACGTTGCA', 20), CAST(1 + aln_id % 4 AS INT), CAST(aln_id % 7 + 5 + aln_id % 30 + 1 + aln_id % 4 + 3 + aln_id % 9 + 2 + aln_id % 6 AS INT)) AS seq,
    aln_id % 2 + 1 AS hp, pos AS ps FROM cigars""",
)
def _(c):
    from strandloom.sources import alignments

    x = alignments.scan_bam(c.sparkSession, _bam_folder(c), step=1 << 18)
    return x.select("qname", "flag", "rname", "pos", "cigar", "seq", F.col("tags")["HP"].cast("int").alias("hp"), F.col("tags")["PS"].cast("long").alias("ps"))


@query(
    "s21_region_scan", "cigars",
    sql="""SELECT concat('r', aln_id) AS qname, pos FROM cigars WHERE chrom = 1 AND pos < 2000 AND pos + CASE WHEN flag & 4 <> 0 THEN 1 ELSE 5 + aln_id % 30 + 3 + aln_id % 9 + 1 + aln_id % 5 + 2 + aln_id % 6 END > 100""",
)
def _(c):
    from strandloom.sources import alignments

    return alignments.scan_bam(c.sparkSession, _bam_folder(c), region="c1:101-2000").select("qname", "pos")


# -- scalar functions --------------------------------------------------------------------------------------------------
@query("x02_run_length", "@part", sql="SELECT p_partkey, CASE WHEN 4 >= length(p_name) THEN 1 ELSE least(10, 1 + length(substring(p_name, 1, 3)) - length(rtrim(substring(p_name, 1, 3), substring(p_name, 4, 1))) + length(substring(p_name, 5, 10)) - length(ltrim(substring(p_name, 5, 10), substring(p_name, 4, 1)))) END AS run FROM part")
def _(p):
    return p.select("p_partkey", strings.run_length(F.col("p_name"), F.lit(3)).cast("long").alias("run"))


@query("x04_repeat2", "@documents", sql="SELECT doc_id, length(substring(text, 12, 2)) = 2 AND substring(text, 12, 4) = repeat(substring(text, 12, 2), 2) AS danger FROM documents")
def _(d):
    return d.select("doc_id", strings.repeat_after(F.col("text"), F.lit(10), 2).alias("danger"))


@query("x06_strand", "aln", sql="SELECT read_id, (flag & 16) <> 0 AS reverse FROM aln")
def _(a):
    return a.select("read_id", (F.col("flag").bitwiseAND(16) != 0).alias("reverse"))


@query("x07_svlen", "vcf", sql="SELECT chrom, pos, -(pos % 300) AS svlen FROM vcf")
def _(v):
    return v.select("chrom", "pos", strings.svlen(F.col("info")).alias("svlen"))


@query("x08_format_field", "vcf", sql="SELECT chrom, pos, gt, CAST(pos + 1 AS VARCHAR) AS ps FROM vcf JOIN (SELECT chrom AS c, pos AS p, gt FROM variants) g ON c = chrom AND p = pos")
def _(v):
    return v.select("chrom", "pos", strings.field(F.col("format"), F.col("sample"), "GT").alias("gt"), strings.field(F.col("format"), F.col("sample"), "PS").alias("ps"))


@query("x09_gt_unphase", "variants", sql="SELECT chrom, pos, CASE gt WHEN '1|0' THEN '0/1' ELSE gt END AS gt FROM variants")
def _(v):
    return v.select("chrom", "pos", strings.unphased(F.col("gt")).alias("gt"))


_STRIPPED = "CASE pos % 2 WHEN 0 THEN 'GT:DP' ELSE 'GT:AD' END AS format, CASE pos % 2 WHEN 0 THEN concat(gt, ':', pos % 40) ELSE concat(gt, ':', pos % 9) END AS sample"


@query("x10_ps_strip", "vcf", sql=f"SELECT chrom, pos, {_STRIPPED} FROM variants")
def _(v):
    f, s = strings.without_field(F.col("format"), F.col("sample"), "PS")
    return v.select("chrom", "pos", f.alias("f"), s.alias("s")).toDF("chrom", "pos", "format", "sample")


@query("x11_ps_append", "vcf", sql="SELECT chrom, pos, concat(format, ':PS') AS format, concat(replace(sample, gt, '0|1'), ':7') AS sample FROM (SELECT chrom, pos, gt, CASE pos % 2 WHEN 0 THEN 'GT:DP' ELSE 'GT:AD' END AS format, CASE pos % 2 WHEN 0 THEN concat(gt, ':', pos % 40) ELSE concat(gt, ':', pos % 9) END AS sample FROM variants) t")
def _(v):
    f, s = strings.without_field(F.col("format"), F.col("sample"), "PS")
    x = v.select("chrom", "pos", f.alias("f"), s.alias("s"))
    return x.select("chrom", "pos", F.concat("f", F.lit(":PS")).alias("format"), F.concat(strings.set_field(F.col("f"), F.col("s"), "GT", F.lit("0|1")), F.lit(":7")).alias("sample"))


@query("x16_contig_header", "@orders", sql="SELECT o_orderkey, concat('chr', o_orderkey % 22) AS contig, o_orderkey * 10 AS length FROM orders")
def _(o):
    line = F.concat(F.lit("##contig=<ID=chr"), F.col("o_orderkey") % 22, F.lit(",length="), F.col("o_orderkey") * 10, F.lit(">"))
    return o.select("o_orderkey", strings.between(line, "ID=", ",length=").alias("contig"), strings.between(line, ",length=", ">").cast("long").alias("length"))


@query("x17_ps_index", "variants", sql="SELECT chrom, pos, dense_rank() OVER (PARTITION BY chrom ORDER BY pos // 10) AS ps FROM variants")
def _(v):
    return v.select("chrom", "pos", F.dense_rank().over(Window.partitionBy("chrom").orderBy(F.expr("pos div 10"))).cast("long").alias("ps"))


@query("x20_info_list", "calls", sql="SELECT chrom, pos, concat('MR=', string_agg(CAST(read_id AS VARCHAR), ',' ORDER BY scan_ord), ';') AS info FROM calls WHERE prob >= 204 GROUP BY chrom, pos")
def _(c):
    return _sites(c).where("n_mod > 0").select("chrom", "pos", strings.info_list("MR", F.col("mod_reads")).alias("info"))


_LENGTHS = f"{_OPS}, l AS (SELECT aln_id, CAST(sum(CASE WHEN op IN ('M','=','X','I','S') THEN CAST(n AS BIGINT) ELSE 0 END) AS BIGINT) AS qlen, CAST(sum(CASE WHEN op IN ('M','=','X','D','N') THEN CAST(n AS BIGINT) ELSE 0 END) AS BIGINT) AS rlen FROM k GROUP BY aln_id)"


@query("x21_cigar_lengths", "cigars", sql=f"{_LENGTHS} SELECT c.aln_id, qlen, rlen, c.pos + CASE WHEN (flag & 4) <> 0 THEN 1 ELSE rlen END AS endpos FROM cigars c JOIN l ON c.aln_id = l.aln_id")
def _(c):
    return c.select("aln_id", cigar.query_length(F.col("cigar")).alias("qlen"), cigar.ref_length(F.col("cigar")).alias("rlen"), cigar.end_position(F.col("pos"), F.col("cigar"), F.col("flag")).alias("endpos"))


@query("x22_flag_names", "aln", sql="SELECT read_id, concat_ws(',', CASE WHEN (flag2 & 4) <> 0 THEN 'UNMAP' END, CASE WHEN (flag2 & 16) <> 0 THEN 'REVERSE' END, CASE WHEN (flag2 & 256) <> 0 THEN 'SECONDARY' END, CASE WHEN (flag2 & 1024) <> 0 THEN 'DUP' END, CASE WHEN (flag2 & 2048) <> 0 THEN 'SUPPLEMENTARY' END) AS names FROM aln")
def _(a):
    return a.select("read_id", strings.flag_names(F.col("flag2")).alias("names"))


@query("x23_variant_type", "variants", sql="SELECT chrom, pos, CASE WHEN length(alt) = 1 AND alt = ref THEN 'REF' WHEN length(alt) = 1 THEN 'SNP' WHEN substring(alt, 1, 1) = ref OR substring(alt, 3, 1) = ref THEN 'INS' ELSE 'OTHER' END AS vt FROM variants WHERE alt NOT LIKE '%,%'")
def _(v):
    return v.where(variants.biallelic(F.col("alt"))).select("chrom", "pos", strings.variant_type(F.col("ref"), F.col("alt"))["type"].alias("vt"))


@query("x24_gt_class", "variants", sql="SELECT chrom, pos, CASE gt WHEN '1/1' THEN 'HOM_AA' ELSE 'HET_RA' END AS class FROM variants")
def _(v):
    return v.select("chrom", "pos", strings.genotype_class(F.col("gt")).alias("class"))


@query("x26_region_parse", "intervals", sql="SELECT iv, concat('chr', chrom) AS chrom, start_pos + 1000 AS start_pos, end_pos + 1000 AS end_pos FROM intervals")
def _(i):
    text = F.concat(F.lit("chr"), "chrom", F.lit(":"), F.format_number(F.col("start_pos") + 1000, 0), F.lit("-"), F.format_number(F.col("end_pos") + 1000, 0))
    return i.select("iv", strings.region(text).alias("r")).select("iv", "r.chrom", F.col("r.start").alias("start_pos"), F.col("r.end").alias("end_pos"))


@query("k01_vcf_lines", "vcf", "assigned", sql="SELECT v.chrom, v.pos, CASE WHEN a.hp IS NULL THEN concat(v.format, ':PS', chr(9), v.sample, ':.') ELSE concat(v.format, ':PS', chr(9), CASE a.hp WHEN 1 THEN '0|1' ELSE '1|0' END, substring(v.sample, 4), ':', a.ps) END AS line FROM (SELECT chrom, pos, CASE pos % 2 WHEN 0 THEN 'GT:DP' ELSE 'GT:AD' END AS format, concat(CASE gt WHEN '1|0' THEN '0/1' ELSE gt END, ':', CASE pos % 2 WHEN 0 THEN pos % 40 ELSE pos % 9 END) AS sample FROM variants) v LEFT JOIN (SELECT * FROM assigned WHERE pos % 3 <> 0) a ON v.chrom = a.chrom AND v.pos = a.pos")
def _(v, a):
    from strandloom.sources.vcf import rewritten

    x = v.join(a.where("pos % 3 <> 0"), ["chrom", "pos"], "left")
    gt = F.when(F.col("hp") == 1, "0|1").when(F.col("hp") == 2, "1|0")
    f, s = rewritten(F.col("format"), F.col("sample"), gt, F.col("ps"))
    return x.select("chrom", "pos", F.concat_ws("\t", f, s).alias("line"))


# -- alleles removed ---------------------------------------------------------------------------------------------------
def _three_alternatives(orders: DataFrame) -> DataFrame:
    """Records of four alleles, one an order, with values by alternative, allele and genotype. Keys are dealt first: a file of few row groups would leave all work to few tasks."""
    orders = orders.select("o_orderkey").repartition(int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    o = F.col("o_orderkey")
    text = lambda *parts: F.concat_ws(",", *[p.cast("string") for p in parts])
    info = F.concat(F.lit("DP="), o % 9, F.lit(";AC="), text(o % 2, o % 3, o % 5), F.lit(";AD="), text(F.lit(1), o % 4, o % 6, o % 7))
    sample = F.concat(o % 4, F.lit("|"), F.floor(o / 3) % 4, F.lit(":"), text(*[(o + 7 * k) % 50 for k in range(10)]))
    cells = [F.lit("1"), o.cast("string"), *map(F.lit, (".", "A", "C,G,T", ".", ".")), info, F.lit("GT:PL"), sample]
    return orders.select("o_orderkey", F.array(*cells).alias("fields"))


_REMOVED = """WITH o AS (SELECT o_orderkey, o_orderkey AS o, (o_orderkey // 3) % 4 AS second, {keep} AS keep FROM orders),
    k AS (SELECT *, list_filter(keep, lambda a: a > 0) AS alts FROM o)
    SELECT o_orderkey, concat_ws(chr(9), '1', o, '.', 'A', CASE WHEN len(alts) = 0 THEN '.' ELSE array_to_string(list_transform(alts, lambda a: ['C', 'G', 'T'][a]), ',') END, '.', '.',
      'DP=' || (o % 9) || ';AC=' || CASE WHEN len(alts) = 0 THEN '.' ELSE array_to_string(list_transform(alts, lambda a: [o % 2, o % 3, o % 5][a]), ',') END || ';AD=' || array_to_string(list_transform(keep, lambda a: [1, o % 4, o % 6, o % 7][a + 1]), ','), 'GT:PL',
      coalesce(CAST(list_position(keep, CAST(o % 4 AS INT)) - 1 AS VARCHAR), '.') || '|' || coalesce(CAST(list_position(keep, CAST(second AS INT)) - 1 AS VARCHAR), '.') || ':'
      || array_to_string(list_transform(list_filter(range(10), lambda g: list_contains(keep, [0, 1, 1, 2, 2, 2, 3, 3, 3, 3][g + 1]) AND list_contains(keep, [0, 0, 1, 0, 1, 2, 0, 1, 2, 3][g + 1])), lambda g: (o + 7 * g) % 50), ',')) AS line FROM k"""


@query("x25_trim_alleles", "@orders", sql=_REMOVED.format(keep="list_filter([0, 1, 2, 3], lambda a: a IN (0, o_orderkey % 4, (o_orderkey // 3) % 4))"))
def _(o):
    return _three_alternatives(o).select("o_orderkey", F.array_join(alleles.trimmed(F.col("fields"), {"AC": "A", "AD": "R"}, {"PL": "G"}), "\t").alias("line"))


@query("v11_remove_alleles", "@orders", sql=_REMOVED.format(keep="list_filter([0, 1, 2, 3], lambda a: a <> 1 + o_orderkey % 3)"))
def _(o):
    drop = F.array((1 + F.col("o_orderkey") % 3).cast("int"))
    return _three_alternatives(o).select("o_orderkey", F.array_join(alleles.without_alleles(F.col("fields"), drop, {"AC": "A", "AD": "R"}, {"PL": "G"}), "\t").alias("line"))


# -- headers -----------------------------------------------------------------------------------------------------------
def _header_lines(orders: DataFrame) -> DataFrame:
    """Meta lines of five files, one an order."""
    o = F.col("o_orderkey")
    info = F.concat(F.lit("##INFO=<ID=I"), F.floor(o / 4) % 20, F.lit(",Number="), F.when(F.floor(o / 80) % 2 == 0, "1").otherwise("A"), F.lit(",Type=Integer>"))
    other = F.when(o % 4 == 1, F.concat(F.lit("##contig=<ID=chr"), F.floor(o / 4) % 30, F.lit(">"))).when(o % 4 == 2, F.concat(F.lit("##tool"), o % 7, F.lit("=v"), o % 3))
    return orders.select((o % 5).alias("file"), o.alias("line_no"), F.when(o % 4 == 0, info).otherwise(F.coalesce(other, F.concat(F.lit("##SAMPLE=<Name=x"), o % 6, F.lit(">")))).alias("line"))


_LINES = """WITH l AS (SELECT o_orderkey % 5 AS file, o_orderkey AS o, CASE o_orderkey % 4 WHEN 0 THEN concat('##INFO=<ID=I', (o_orderkey // 4) % 20, ',Number=', CASE WHEN (o_orderkey // 80) % 2 = 0 THEN '1' ELSE 'A' END, ',Type=Integer>') WHEN 1 THEN concat('##contig=<ID=chr', (o_orderkey // 4) % 30, '>')
      WHEN 2 THEN concat('##tool', o_orderkey % 7, '=v', o_orderkey % 3) ELSE concat('##SAMPLE=<Name=x', o_orderkey % 6, '>') END AS line FROM orders),
    d AS (SELECT *, CASE o % 4 WHEN 0 THEN (o // 4) % 20 WHEN 1 THEN (o // 4) % 30 WHEN 2 THEN o % 7 END AS name FROM l)"""


@query("u06_header_union", "@orders", sql=f"{_LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY o % 4, name ORDER BY file, o) AS rn, min(file) OVER (PARTITION BY o % 4, name) AS owner, min(file) OVER () AS least FROM d) SELECT file, o AS line_no, line FROM r WHERE CASE WHEN o % 4 < 2 THEN rn = 1 WHEN o % 4 = 2 THEN file = owner ELSE file = least END")
def _(o):
    return headers.union(_header_lines(o)).select("file", "line_no", "line")


@query(
    "v12_header_translation", "@orders",
    sql=f"""{_LINES}, f AS (SELECT file, o % 4 AS k, name, min(o) AS o FROM d WHERE o % 4 < 2 GROUP BY ALL), g AS (SELECT file, k, name, row_number() OVER (PARTITION BY file, k ORDER BY o) - k AS own FROM f),
    u AS (SELECT k, name, row_number() OVER (PARTITION BY k ORDER BY file, o) - k AS n FROM (SELECT *, row_number() OVER (PARTITION BY k, name ORDER BY file, o) AS rn FROM f) x WHERE rn = 1)
    SELECT file, CASE k WHEN 0 THEN 'id' ELSE 'contig' END AS kind, concat(CASE k WHEN 0 THEN 'I' ELSE 'chr' END, name) AS id, own, n FROM g JOIN u USING (k, name)""",
)
def _(o):
    return headers.translation(_header_lines(o)).select("file", "kind", "id", "own", "n")


# -- filter language ---------------------------------------------------------------------------------------------------
_LINE = {"qty": "l_quantity", "price": "l_extendedprice", "line": "l_linenumber", "flag": "l_orderkey", "rf": "l_returnflag", "ls": "l_linestatus"}
#: name, expression, the same in SQL
EXPRESSIONS = (
    ("e01_literals", 'rf == "A" && 0x10 == 16', "l_returnflag = 'A'"),
    ("e02_unary", "!(qty > 25) && -line < -2 && ~line == -4", "NOT (l_quantity > 25) AND -l_linenumber < -2 AND l_linenumber = 3"),
    ("e03_products", "flag % 7 == 3 && qty / 2 > 10 && line * 2 == 6", "l_orderkey % 7 = 3 AND l_quantity / 2 > 10 AND l_linenumber * 2 = 6"),
    ("e04_sums", "qty + line - 3 >= 40", "l_quantity + l_linenumber - 3 >= 40"),
    ("e05_bits", "(flag & 5 | 2 ^ 1) == 7", "(((l_orderkey & 5) | xor(2, 1))) = 7"),
    ("e06_order", 'qty >= 10 && qty < 20 && rf > "A"', "l_quantity >= 10 AND l_quantity < 20 AND l_returnflag > 'A'"),
    ("e07_equality", 'line != 1 && rf == "N" && line != "x"', "l_linenumber <> 1 AND l_returnflag = 'N'"),
    ("e08_match", 'rf =~ "^[[:upper:]]$" && rf !~ "[AR]"', "l_returnflag NOT IN ('A', 'R')"),
    ("e09_logic", "line == 1 || line == 2 && qty > 25", "(l_linenumber = 1 OR l_linenumber = 2) AND l_quantity > 25"),
    ("e10_strings", "length(rf) == 1 && max(rf) > 77 && min(rf) < 80 && avg(rf) == 78", "l_returnflag = 'N'"),
    ("e11_exists", "exists(missing) || default(missing, line) == 4", "l_linenumber = 4"),
    ("e12_maths", "sqrt(qty) > 5 && pow(line, 2) == 9 && log(qty) < 4 && exp(line) > 20", "sqrt(l_quantity) > 5 AND l_linenumber = 3 AND ln(l_quantity) < 4 AND exp(l_linenumber) > 20"),
    ("e15_unknown", "!(missing > 3)", "true"),
)


def _expression(text: str):
    def run(li: DataFrame) -> DataFrame:
        names = {k: F.col(c) for k, c in _LINE.items()} | {"missing": F.lit(None).cast("double")}
        return li.where(filters.predicate(text, names, {"rf": "str", "ls": "str"})).select("l_orderkey", "l_linenumber", "l_quantity")

    return run


for _name, _text, _sql in EXPRESSIONS:
    query(_name, "@lineitem", sql=f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE {_sql}")(_expression(_text))


@query("e14_tags", "@events", sql="SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) > 50")
def _(e):
    tags = F.from_json("props", "map<string,string>")
    return e.select("event_id", F.map_from_arrays(F.array(F.lit("KK")), F.array(F.try_element_at(tags, F.lit("k")))).alias("tags")).where(filters.predicate("default([KK], \"0\") =~ \"^(5[1-9]|[6-9][0-9]|[1-9][0-9][0-9]+)$\"", {}, {}, F.col("tags"))).select("event_id")


# -- whole commands and the rest ---------------------------------------------------------------------------------------
_JUDGED = f"{_TAG}, j AS (SELECT *, CASE WHEN greatest(h1, h2) * 10 < 6 * (h1 + h2) OR n_ps > 1 OR h1 = h2 THEN 0 WHEN h1 > h2 THEN 1 ELSE 2 END AS hp FROM v)"


@query("p2_haplotag", "obs", "assigned", "aln", sql=f"{_JUDGED} SELECT a.chrom, a.read_id, coalesce(j.hp, 0) AS hp, CASE WHEN j.hp > 0 THEN j.ps END AS ps FROM aln a LEFT JOIN j ON j.chrom = a.chrom AND j.read_id = a.read_id")
def _(o, a, x):
    j = tag.judged(tag.votes(o, a))
    out = x.select("chrom", "read_id").join(j.select("chrom", "read_id", "hp", "ps"), ["chrom", "read_id"], "left")
    return out.select("chrom", "read_id", F.coalesce("hp", F.lit(0)).alias("hp"), F.when(F.col("hp") > 0, F.col("ps")).alias("ps"))


@query("k08_tag_log", "obs", "assigned", sql=f"{_JUDGED} SELECT CAST(read_id AS VARCHAR) AS read_name, CASE hp WHEN 0 THEN '.' ELSE CAST(hp AS VARCHAR) END AS haplotype, CASE hp WHEN 0 THEN '.' ELSE CAST(ps AS VARCHAR) END AS phase_set, total AS n_alleles, CAST(h1 AS BIGINT) AS h1, CAST(h2 AS BIGINT) AS h2 FROM j")
def _(o, a):
    j = tag.judged(tag.votes(o, a)).withColumn("read_name", F.col("read_id").cast("string")).withColumn("start", F.lit(0))
    log = tag.log_rows(j)
    return log.select(F.col("Read").alias("read_name"), F.col("Haplotype").alias("haplotype"), F.col("PhaseSet").alias("phase_set"), F.col("TotalAllele").alias("n_alleles"), F.col("HP1Allele").alias("h1"), F.col("HP2Allele").alias("h2"))


_GENOTYPED = f"""{_SITES}, pp AS (SELECT a.chrom, a.pos, a.n_mod + b.n_mod AS n_mod, a.n_unmod + b.n_unmod AS n_unmod, a.depth + b.depth AS depth FROM s a JOIN s b ON a.chrom = b.chrom AND b.pos = a.pos + 1 WHERE a.strand = 0 AND b.strand = 1),
    pq AS (SELECT chrom, pos, {_GT} AS pair FROM pp), sg AS (SELECT s.*, coalesce(pair, {_GT}) AS gt, pair IS NOT NULL AS paired FROM s LEFT JOIN pq ON pq.chrom = s.chrom AND pq.pos = s.pos - s.pos % 2)"""


@query("p3_modcall_sites", "calls", sql=f"{_GENOTYPED} SELECT chrom, pos, n_mod, n_unmod, depth, gt, paired FROM sg")
def _(c):
    return methyl.genotyped(_sites(c)).select("chrom", "pos", "n_mod", "n_unmod", "depth", "gt", "paired")


@query(
    "k09_modcall_lines", "calls",
    sql=f"""{_GENOTYPED}, names AS (SELECT chrom, pos, coalesce(string_agg(CAST(read_id AS VARCHAR), ',' ORDER BY scan_ord) FILTER ({_CALL} = 'mod'), '') AS mr, coalesce(string_agg(CAST(read_id AS VARCHAR), ',' ORDER BY scan_ord) FILTER ({_CALL} = 'unmod'), '') AS nr FROM calls GROUP BY chrom, pos)
    SELECT sg.chrom, sg.pos, concat_ws(chr(9), sg.chrom, sg.pos + 1, '.', substring('ACGTN', CAST(sg.pos % 5 AS INT) + 1, 1), 'N', '.', 'PASS', concat('RS=', CASE sg.pos % 2 WHEN 0 THEN 'P' ELSE 'N' END, ';MR=', mr, ';NR=', nr, ';'), 'GT:MD:UD:DP', concat_ws(':', gt, n_mod, n_unmod, depth)) AS line
    FROM sg JOIN names n ON n.chrom = sg.chrom AND n.pos = sg.pos WHERE gt = '0/1' AND sg.pos % 5 < 4""",
)
def _(c):
    from strandloom.plans.api import modcall_lines

    s = methyl.genotyped(_sites(c)).where("gt = '0/1'")
    return modcall_lines(s, s.select("chrom", "pos", F.substring(F.lit("ACGTN"), (F.col("pos") % 5).cast("int") + 1, F.lit(1)).alias("base")))


@query("u02_union_unplaced", "aln", sql="SELECT read_id, true AS placed FROM aln WHERE (flag2 & 4) = 0 UNION ALL SELECT read_id, false FROM aln WHERE (flag2 & 4) <> 0")
def _(a):
    un = F.col("flag2").bitwiseAND(4) != 0
    return a.where(~un).select("read_id", F.lit(True).alias("placed")).unionByName(a.where(un).select("read_id", F.lit(False).alias("placed")))


@query("v02_index_statistics", "aln", sql="SELECT chrom AS rname, count(CASE WHEN (flag2 & 4) = 0 THEN 1 END) AS mapped, count(CASE WHEN (flag2 & 4) <> 0 THEN 1 END) AS unmapped FROM aln GROUP BY chrom")
def _(a):
    from strandloom.sources.alignments import index_statistics

    return index_statistics(a.withColumnRenamed("chrom", "rname").drop("flag").withColumnRenamed("flag2", "flag"))


@query("v09_quickselect", "aln", sql="SELECT chrom, min(mapq) AS median FROM (SELECT chrom, mapq, row_number() OVER (PARTITION BY chrom ORDER BY mapq) AS rn, count(*) OVER (PARTITION BY chrom) AS n FROM aln) t WHERE rn = (n + 1) // 2 GROUP BY chrom")
def _(a):
    w = Window.partitionBy("chrom")
    x = a.groupBy("chrom", "mapq").agg(F.count("*").alias("k"))  # a row a value: nothing is sorted in full
    x = x.withColumn("upto", F.sum("k").over(w.orderBy("mapq"))).withColumn("n", F.sum("k").over(w))
    return x.where(F.col("upto") >= F.expr("(n + 1) div 2")).groupBy("chrom").agg(F.min("mapq").alias("median"))


@query("t01_pileup_columns", "cigars")
def _(c):
    return depth.pileup_columns(cigar.blocks(c, ["chrom", "aln_id"]), ["chrom", "aln_id"])


_LOG_TABLE = "lgamma(a + 1) - lgamma(k + 1) - lgamma(a - k + 1) + lgamma(n - a + 1) - lgamma(c - k + 1) - lgamma(n - a - c + k + 1) - lgamma(n + 1) + lgamma(c + 1) + lgamma(n - c + 1)"


@query(
    "x27_fisher_exact", "obs",
    sql=f"""SELECT chrom, pos, round(least(1.0, sum(p) FILTER (p <= own * (1 + 1e-8))), 9) AS p FROM (SELECT chrom, pos, p, max(p) FILTER (k = n00) OVER (PARTITION BY chrom, pos) AS own
      FROM (SELECT *, exp({_LOG_TABLE}) AS p FROM (SELECT *, unnest(range(greatest(0, a + c - n), least(a, c) + 1)) AS k
        FROM (SELECT chrom, pos, n00, n00 + n01 AS a, n00 + n10 AS c, n00 + n01 + n10 + n11 AS n FROM (SELECT chrom, pos, count(*) FILTER (allele = 0 AND read_id % 2 = 0) AS n00, count(*) FILTER (allele = 0 AND read_id % 2 = 1) AS n01,
          count(*) FILTER (allele = 1 AND read_id % 2 = 0) AS n10, count(*) FILTER (allele = 1 AND read_id % 2 = 1) AS n11 FROM obs GROUP BY chrom, pos) x) y) z) w) v GROUP BY chrom, pos""",
)
def _(o):
    from strandloom.functions import stats

    n = o.groupBy("chrom", "pos").agg(*[F.count_if((F.col("allele") == a) & (F.col("read_id") % 2 == r)).cast("int").alias(f"n{a}{r}") for a in (0, 1) for r in (0, 1)])
    return n.select("chrom", "pos", F.round(stats.fisher_exact("n00", "n01", "n10", "n11")["two"], 9).alias("p"))


@query("s15_base_modifications", "@events")
def _(e):
    from strandloom.functions import basemods

    tags = F.create_map(F.lit("MM"), F.concat(F.lit("C+m,"), F.col("event_id") % 3, F.lit(",0;")), F.lit("ML"), F.concat(F.lit("C,"), F.col("user_id") % 256, F.lit(",200")))
    return basemods.modifications(e.select(F.col("event_id").alias("aln_id"), F.when(F.col("user_id") % 2 == 0, 0).otherwise(16).alias("flag"), F.lit("ACGTCCGATCGCGGCATCGG").alias("seq"), tags.alias("tags")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phased blocks of the gapped observations."""
    from strandloom.plans.api import phase_observations

    return phase.block_summary(phase_observations(view(spark, sf_dir, "obs_gapped")))


QUERIES["p1_phase_blocks"] = flagship
