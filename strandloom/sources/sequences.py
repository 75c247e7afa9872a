"""FASTA as tiles, FASTQ as reads, and interval files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, seq): one tile a line, start 0-based. Contigs are found by their header lines, of which there are few; lines are joined to them by place, so no task reads the file whole."""
    x = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
    head = x.where(F.startswith("line", F.lit(">")))
    w = Window.orderBy("n")
    head = head.select("n", F.regexp_extract("line", r"^>(\S+)", 1).alias("chrom"), F.coalesce(F.lead("n").over(w), F.lit((1 << 63) - 1)).alias("next"))
    body = x.where(~F.startswith("line", F.lit(">")) & (F.length("line") > 0)).withColumnRenamed("n", "m")
    t = body.join(F.broadcast(head), (body["m"] > head["n"]) & (body["m"] < head["next"]))
    before = Window.partitionBy("chrom").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    return t.select("chrom", F.coalesce(F.sum(F.length("line")).over(before), F.lit(0)).alias("start"), F.upper("line").alias("seq"))


def contig_lengths(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("chrom").agg(F.sum(F.length("seq")).alias("length"))


def fetch(tiles: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """One row: the bases start..end (0-based, end exclusive), clamped to the contig."""
    first = F.greatest(F.lit(start) - F.col("start"), F.lit(0))
    part = tiles.where((F.col("chrom") == chrom) & (F.col("start") < end) & (F.col("start") + F.length("seq") > start))
    piece = F.substring("seq", first.cast("int") + 1, (F.lit(end) - F.col("start") - first).cast("int"))
    return part.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", piece.alias("p")))), lambda x: x["p"]), "").alias("seq"))


def around(points: DataFrame, tiles: DataFrame, reach: int = 11) -> DataFrame:
    """points (chrom, pos) with ``context``: the bases pos - reach .. pos + reach as far as the contig goes, and ``offset``, the place of pos in it."""
    size = 1 << 10
    p = points.withColumn("_s", F.greatest(F.col("pos") - reach, F.lit(0))).withColumn("_e", F.col("pos") + reach)
    p = p.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_s") / size), F.floor(F.col("_e") / size))))
    t = tiles.withColumn("_end", F.col("start") + F.length("seq") - 1).withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(F.col("_end") / size))))
    x = p.join(t, ["chrom", "_b"]).where("start <= _e and _end >= _s")
    first = F.greatest(F.col("_s") - F.col("start"), F.lit(0))
    piece = F.substring("seq", first.cast("int") + 1, (F.least("_e", "_end") - F.col("start") - first + 1).cast("int"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("start", piece.alias("p")))), lambda v: v["p"]), "")
    rest = [c for c in points.columns]
    return x.groupBy(*rest, "_s").agg(joined.alias("context")).withColumn("offset", F.col("pos") - F.col("_s")).drop("_s")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(name, read_no, comment, seq, qual). Four lines a read; a record is read as one by cutting the text before its name line."""
    x = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
    # places are consecutive within a partition only, so lines are numbered by partition sizes
    part = F.shiftright("n", 33)
    sizes = x.groupBy(part.alias("part")).agg(F.count("*").alias("c"))
    before = sizes.select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("before"))
    x = x.withColumn("part", part).join(F.broadcast(before), "part").withColumn("k", F.col("before") + F.col("n").bitwiseAND((1 << 33) - 1))
    g = x.groupBy(F.floor(F.col("k") / 4).alias("rec")).agg(*[F.max(F.when(F.col("k") % 4 == j, F.col("line"))).alias(f"l{j}") for j in (0, 1, 3)])
    name = F.regexp_extract("l0", r"^@(\S+)", 1)
    return g.select(F.regexp_replace(name, "/[12]$", "").alias("name"), F.regexp_extract(name, "/([12])$", 1).try_cast("int").alias("read_no"), F.regexp_extract("l0", r"^\S+\s+(.*)$", 1).alias("comment"), F.col("l1").alias("seq"), F.col("l3").alias("qual"))


def casava_filtered(comment: Column) -> Column:
    """Whether a CASAVA comment (read:filtered:control:index) marks a filtered read."""
    return F.split(comment, ":")[1] == "Y"


def read_intervals(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(chrom, start, end), 0-based inclusive, of a bed, gff, vcf, tab (1-based) or reg file."""
    x = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.length(F.trim("value")) > 0))
    f = lambda k: F.try_element_at(F.split("value", "\t"), F.lit(k + 1))
    n = lambda k: f(k).cast("long")
    if kind == "bed":
        return x.select(f(0).alias("chrom"), n(1).alias("start"), (n(2) - 1).alias("end"))
    if kind == "gff":
        return x.select(f(0).alias("chrom"), (n(3) - 1).alias("start"), (n(4) - 1).alias("end"))
    if kind == "vcf":
        return x.select(f(0).alias("chrom"), (n(1) - 1).alias("start"), (n(1) - 2 + F.length(f(3))).alias("end"))
    if kind == "tab":
        return x.select(f(0).alias("chrom"), (n(1) - 1).alias("start"), F.coalesce(n(2), n(1)).alias("e")).select("chrom", "start", (F.col("e") - 1).alias("end"))
    if kind == "reg":
        from strandloom.functions.strings import region

        return x.select(region(F.col("value")).alias("r")).select("r.chrom", (F.col("r.start") - 1).alias("start"), F.coalesce(F.col("r.end") - 1, F.lit((1 << 31) - 1)).alias("end"))
    raise ValueError(f"unknown kind {kind}")


def sniffed(head: bytes) -> str:
    """The format of a file by its first bytes."""
    if head[:4] == b"\x1f\x8b\x08\x04" and head[12:14] == b"BC":
        return "bgzf"
    for magic, name in ((b"\x1f\x8b", "gzip"), (b"BAM\1", "bam"), (b"CRAM", "cram"), (b"BCF", "bcf"), (b"##fileformat=VCF", "vcf"), (b"PAR1", "parquet"), (b"@HD\t", "sam"), (b"@SQ\t", "sam"), (b">", "fasta")):
        if head.startswith(magic):
            return name
    if head.startswith(b"@") and b"\n+" in head:
        return "fastq"
    return "text"
