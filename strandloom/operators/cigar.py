"""CIGAR strings as blocks, and the alleles that reads show at variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.ranges import BIN, point_join
from strandloom.params import INDEL, REPEAT_INDEL, SNP, SV

OP = r"(\d+)([MIDNSHP=XB])"
BOTH, QUERY, REF = ("M", "=", "X"), ("I", "S"), ("D", "N")


def parse(cigar: Column) -> Column:
    """Array of (op, len)."""
    n, op = F.regexp_extract_all(cigar, F.lit(OP), F.lit(1)), F.regexp_extract_all(cigar, F.lit(OP), F.lit(2))
    return F.zip_with(n, op, lambda a, b: F.struct(b.alias("op"), a.cast("long").alias("len")))


def _total(cigar: Column, ops: tuple[str, ...]) -> Column:
    return F.aggregate(F.filter(parse(cigar), lambda x: x["op"].isin(*ops)), F.lit(0).cast("long"), lambda a, x: a + x["len"])


def query_length(cigar: Column) -> Column:
    return _total(cigar, BOTH + QUERY)


def ref_length(cigar: Column) -> Column:
    return _total(cigar, BOTH + REF)


def end_position(pos: Column, cigar: Column, flag: Column) -> Column:
    """Exclusive end; an unmapped read, or one without reference bases, is one base long."""
    n = ref_length(cigar)
    return pos + F.when((flag.bitwiseAND(4) != 0) | (n == 0), F.lit(1)).otherwise(n)


def placed(cigar: Column) -> Column:
    """Array of (op, len, r, q): the operations with the reference and query bases before them."""
    zero = F.struct(F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("q"), F.array().cast("array<struct<op:string,len:bigint,r:bigint,q:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        r = acc["r"] + F.when(x["op"].isin(*BOTH, *REF), x["len"]).otherwise(0)
        q = acc["q"] + F.when(x["op"].isin(*BOTH, *QUERY), x["len"]).otherwise(0)
        one = F.struct(x["op"].alias("op"), x["len"].alias("len"), acc["r"].alias("r"), acc["q"].alias("q"))
        return F.struct(r.alias("r"), q.alias("q"), F.array_append(acc["out"], one).alias("out"))

    return F.aggregate(parse(cigar), zero, step, lambda a: a["out"])


def blocks(reads: DataFrame, keep: list[str], pos: str = "pos", cigar: str = "cigar") -> DataFrame:
    """One row an operation: op_index, op, len, ref_start, query_start (both 0-based), next_op, next_len, first, last.
    Prefix sums are a fold inside the row, so nothing is shuffled."""
    folded = placed(F.col(cigar))
    x = reads.select(*keep, F.col(pos).alias("_pos"), folded.alias("_ops"))
    nxt = lambda f: F.try_element_at("_ops", F.col("op_index") + 2)[f]
    x = x.select(*keep, "_pos", "_ops", F.posexplode("_ops").alias("op_index", "_x"))
    return x.select(
        *keep, "op_index", F.col("_x.op").alias("op"), F.col("_x.len").alias("len"), (F.col("_pos") + F.col("_x.r")).alias("ref_start"), F.col("_x.q").alias("query_start"),
        nxt("op").alias("next_op"), nxt("len").alias("next_len"), (F.col("op_index") == 0).alias("first"), (F.col("op_index") == F.size("_ops") - 1).alias("last"),
    )


def observations(reads: DataFrame, variants: DataFrame, homopolymers: DataFrame | None = None, size: int = BIN) -> DataFrame:
    """Alleles of reads at SNPs and indels. reads: (chrom, aln_id, read_id, pos, cigar, seq, qual); variants: (chrom, vpos, ref, alt, is_repeat).
    A SNP shows the base in the block; an indel shows the alternative where the block ends exactly at the variant and the matching gap follows.
    A deletion block over a variant in a homopolymer (``homopolymers``: chrom, vpos, run >= 3) still tells: the first such variant of the block
    shows the base after the gap (SNP) or the alternative (deletion). Reads whose sequence ends before a variant are dropped whole."""
    v = variants.select("chrom", "vpos", "ref", "alt", F.coalesce("is_repeat", F.lit(False)).alias("is_repeat"))
    b = blocks(reads, ["chrom", "aln_id", "read_id", "seq", "qual"]).withColumn("ref_end", F.col("ref_start") + F.col("len") - 1)
    m = point_join(b.where(F.col("op").isin(*BOTH)), v, ["chrom"], "ref_start", "ref_end", "vpos", size)
    q = F.col("query_start") + F.col("vpos") - F.col("ref_start")
    base = F.substring("seq", q.cast("int") + 1, F.lit(1))
    snp = (F.length("ref") == 1) & (F.length("alt") == 1)
    ins, dele = (F.length("ref") == 1) & (F.length("alt") > 1), (F.length("ref") > 1) & (F.length("alt") == 1)
    at_end = F.col("vpos") == F.col("ref_end")
    allele = (
        F.when(snp, F.when(base == F.col("ref"), 0).when(base == F.col("alt"), 1))
        .when(ins & ~F.col("last"), F.when(at_end & (F.col("next_op") == "I"), 1).otherwise(0))
        .when(dele & ~F.col("last"), F.when(at_end & (F.col("next_op") == "D"), 1).otherwise(0))
    )
    kind = F.when(snp, SNP).when(F.col("is_repeat"), REPEAT_INDEL).otherwise(INDEL)
    quality = F.when(snp, F.ascii(F.substring("qual", q.cast("int") + 1, F.lit(1))) - 33).otherwise(60)
    m = m.withColumn("short", q >= F.length("seq")).withColumn("allele", allele).withColumn("vtype", kind).withColumn("quality", quality)
    if homopolymers is not None:
        d = point_join(b.where("op = 'D'"), v, ["chrom"], "ref_start", "ref_end", "vpos", size)
        first = Window.partitionBy("chrom", "aln_id", "op_index").orderBy("vpos")
        d = d.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").join(homopolymers.select("chrom", "vpos").distinct(), ["chrom", "vpos"], "left_semi")
        after = F.substring("seq", F.col("query_start").cast("int") + 1, F.lit(1))
        gap = F.when(snp, F.when(after == F.col("ref"), 0).when(after == F.col("alt"), 1)).when(dele, 1)
        d = d.withColumn("short", F.col("query_start") >= F.length("seq")).withColumn("allele", gap).withColumn("vtype", F.when(snp, SNP).otherwise(INDEL))
        d = d.withColumn("quality", F.when(snp, F.ascii(F.substring("qual", F.col("query_start").cast("int") + 1, F.lit(1))) - 33).otherwise(60))
        m = m.unionByName(d.select(m.columns))
    bad = m.where("short").select("chrom", "aln_id").distinct()
    return m.where("allele is not null").join(bad, ["chrom", "aln_id"], "left_anti").select("chrom", "aln_id", "read_id", F.col("vpos").alias("pos"), "allele", F.col("quality").alias("qual"), "vtype")


def sv_similar(svlen: Column, op_length: Column) -> Column:
    """Relative difference of an operation's length from the variant's region."""
    region = F.abs(svlen) + 1
    return F.try_divide(F.abs(region - op_length), region)


def sv_observations(reads: DataFrame, svs: DataFrame, window: int = 20, threshold: float = 0.10, size: int = BIN) -> DataFrame:
    """Allele 1 where an insertion or deletion of about the variant's length lies within window operations of the one that covers its start."""
    b = blocks(reads, ["chrom", "aln_id", "read_id", "cigar"]).withColumn("ref_end", F.col("ref_start") + F.col("len") - 1)
    m = point_join(b.where(F.col("op").isin(*BOTH, *REF)), svs.select("chrom", F.col("pos").alias("vpos"), "svlen"), ["chrom"], "ref_start", "ref_end", "vpos", size)
    first = F.greatest(F.col("op_index") - window, F.lit(0))
    near = F.slice(parse(F.col("cigar")), first + 1, F.col("op_index") + window - first)
    hit = F.exists(near, lambda x: x["op"].isin("I", "D") & (sv_similar(F.col("svlen"), x["len"]) < threshold))
    allele = F.when(hit, 1).otherwise(0)
    return m.select("chrom", "aln_id", "read_id", F.col("vpos").alias("pos"), allele.alias("allele"), F.when(hit, 60).otherwise(30).alias("qual"), F.lit(SV).alias("vtype"))


def clip_histogram(reads: DataFrame, least: int = 5) -> DataFrame:
    """(chrom, pos, front, back): clips longer than ``least`` by reference position; front: the alignment's first operation."""
    b = blocks(reads, ["chrom"]).where(F.col("op").isin("S", "H") & (F.col("len") > least))
    return b.groupBy("chrom", F.col("ref_start").alias("pos")).agg(F.count_if("first").alias("front"), F.count_if(~F.col("first")).alias("back"))
