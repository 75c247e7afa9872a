"""VCF text: reading with the lines kept for a lossless rewrite, and writing of phased files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import strings

COLUMNS = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", "sample")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line); plain or gzipped, a last line without newline included. line_no grows with the place in the file."""
    if not any(path.rstrip("/").endswith(x) for x in (".vcf", ".vcf.gz", ".vcf.bgz", ".txt")):
        raise ValueError(f"not a VCF name: {path}")
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def header(lines: DataFrame) -> DataFrame:
    """(line_no, key, value, id) of the meta lines."""
    h = lines.where(F.startswith("line", F.lit("##")))
    value = F.regexp_extract("line", "^##[^=]+=(.*)$", 1)
    return h.select("line_no", F.regexp_extract("line", "^##([^=]+)=", 1).alias("key"), value.alias("value"), F.regexp_extract(value, r"<ID=([^,>]+)", 1).alias("id"))


def contigs(lines: DataFrame) -> DataFrame:
    """(chrom, length, chrom_ord) in header order."""
    c = header(lines).where("key = 'contig'")
    from pyspark.sql import Window

    return c.select(F.col("id").alias("chrom"), F.regexp_extract("value", r"length=(\d+)", 1).try_cast("long").alias("length"), (F.row_number().over(Window.orderBy("line_no")) - 1).alias("chrom_ord"))


def records(lines: DataFrame) -> DataFrame:
    """The records' columns (pos 0-based, first sample only), with line_no and all fields."""
    x = lines.where(~F.startswith("line", F.lit("#")) & (F.length(F.trim("line")) > 0)).select("line_no", F.split("line", "\t").alias("fields"))
    at = lambda k: F.try_element_at("fields", F.lit(k + 1))
    out = {c: at(k) for k, c in enumerate(COLUMNS)}
    out["pos"] = out["pos"].cast("long") - 1
    out["qual"] = out["qual"].try_cast("double")
    return x.select("line_no", *[v.alias(k) for k, v in out.items()], "fields").withColumn("gt", strings.field(F.col("format"), F.col("sample"), "GT"))


def snps_and_indels(rec: DataFrame, indels: bool = False, least_quality: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Heterozygous biallelic records to phase, the last of a position, and the indels removed for quality."""
    from strandloom.operators import variants

    het = rec.where(variants.is_het(F.col("gt")) & variants.biallelic(F.col("alt")))
    snp = variants.is_snp(F.col("ref"), F.split("alt", ","))
    kept = het.where(snp | F.lit(indels))
    good = snp | variants.quality_kept(F.col("qual"), least_quality)
    return variants.last_by_position(kept.where(good), "line_no"), kept.where(~good).select("chrom", "pos", "ref", "alt", "qual")


def svs(rec: DataFrame, snps: DataFrame) -> DataFrame:
    """Heterozygous structural variants with a length, at no SNP's position, the first of a position."""
    from strandloom.operators import variants

    x = rec.where(F.substring("gt", 1, 1) != F.substring("gt", 3, 1)).withColumn("svlen", strings.svlen(F.col("info"))).where("svlen is not null")
    return variants.first_by_position(variants.without_conflicts(x, snps), "line_no")


def modifications(rec: DataFrame, snps: DataFrame, sv: DataFrame) -> DataFrame:
    """(chrom, pos, representative, read_name, is_modify, is_reverse): evidence by read, runs of consecutive positions under their first."""
    from strandloom.operators import ranges, variants

    strand = strings.info_value(F.col("info"), "RS")
    x = rec.where(F.substring("gt", 1, 1) != F.substring("gt", 3, 1)).withColumn("strand", strand).where(F.col("strand").isin("P", "N"))
    x = ranges.runs(variants.without_conflicts(variants.without_conflicts(x, snps), sv).dropDuplicates(["chrom", "pos"]), ["chrom"], "pos")
    names = lambda k, m: F.transform(F.filter(F.split(F.coalesce(strings.info_value(F.col("info"), k), F.lit("")), ","), lambda n: n != ""), lambda n: F.struct(n.alias("read_name"), F.lit(m).alias("is_modify")))
    return x.select("chrom", "pos", "representative", (F.col("strand") == "N").alias("is_reverse"), F.explode(F.concat(names("MR", True), names("NR", False))).alias("r")).select("chrom", "pos", "representative", "is_reverse", "r.*")


def phased(rec: DataFrame) -> DataFrame:
    """(chrom, pos, ref, alt, hp, ps): phased heterozygous records; hp is the haplotype of the reference allele. Phase sets that are names get numbers in order of first appearance."""
    from pyspark.sql import Window

    from strandloom.operators import variants

    x = rec.where(variants.phased_het(F.col("gt"))).withColumn("set", strings.field(F.col("format"), F.col("sample"), "PS")).where("set is not null and set <> '.'")
    number = F.col("set").try_cast("long")
    first = x.where(number.isNull()).groupBy("set").agg(F.min("line_no").alias("at")).withColumn("n", F.row_number().over(Window.orderBy("at")).cast("long"))
    x = x.join(F.broadcast(first.select("set", "n")), "set", "left") if not x.where(number.isNull()).isEmpty() else x.withColumn("n", F.lit(None).cast("long"))
    return x.select("chrom", "pos", "ref", "alt", F.when(F.substring("gt", 1, 1) == "0", 1).otherwise(2).alias("hp"), F.coalesce(number, "n").alias("ps"))


def rewritten(format_: Column, sample: Column, gt: Column, ps: Column) -> tuple[Column, Column]:
    """FORMAT and sample with PS last: the new genotype and phase set, or the genotype unphased and no set where gt is null."""
    f, s = strings.without_field(format_, sample, "PS")
    new = F.coalesce(gt, strings.unphased(strings.field(format_, sample, "GT")))
    value = F.when(gt.isNotNull(), ps.cast("string")).otherwise(".")
    return F.concat(f, F.lit(":PS")), F.concat(strings.set_field(f, s, "GT", new), F.lit(":"), value)


PS_HEADER = '##FORMAT=<ID=PS,Number=1,Type=Integer,Description="Phase set identifier">'
LOW_INDEL_HEADER = '##FILTER=<ID=INDEL_QUAL_FILTERED,Description="Indel below the quality threshold">'


def phased_lines(lines: DataFrame, result: DataFrame, command: str, removed: DataFrame | None = None, position: str = "pos") -> DataFrame:
    """(line_no, part, line) of the phased file. result: (chrom, pos, gt, ps); removed: (chrom, pos) of indels filtered for quality."""
    rec = records(lines)
    x = rec.join(result.select("chrom", F.col("pos").alias(position), F.col("gt").alias("_gt"), "ps"), ["chrom", position], "left")
    if removed is not None:
        x = x.join(removed.select("chrom", "pos", F.lit(True).alias("_low")), ["chrom", "pos"], "left")
    else:
        x = x.withColumn("_low", F.lit(None).cast("boolean"))
    f, s = rewritten(F.col("format"), F.col("sample"), F.col("_gt"), F.col("ps"))
    cells = F.transform("fields", lambda v, k: F.when((k == 6) & F.coalesce("_low", F.lit(False)), "INDEL_QUAL_FILTERED").when(k == 8, f).when(k == 9, s).otherwise(v))
    body = x.select("line_no", F.lit(1).alias("part"), F.array_join(cells, "\t").alias("line"))
    head = lines.where(F.startswith("line", F.lit("#")))
    has_ps = F.expr("max(startswith(line, '##FORMAT=<ID=PS,')) over ()")
    own = head.withColumn("_ps", has_ps)
    extra = [F.struct(F.lit(k).alias("part"), F.lit(v).alias("line"), F.lit(c).alias("when_missing")) for k, v, c in ((-3, PS_HEADER, True), (-2, f"##commandline=\"{command}\"", False), *(((-1, LOW_INDEL_HEADER, False),) if removed is not None else ()))]
    added = own.where(F.startswith("line", F.lit("#CHROM"))).select("line_no", "_ps", F.explode(F.array(*extra)).alias("x")).where("not (x.when_missing and _ps)").select("line_no", "x.part", "x.line")
    return body.unionByName(head.select("line_no", F.lit(1).alias("part"), "line")).unionByName(added)


def write_lines(parts: DataFrame, path: str) -> None:
    """Text in order; files sort by name, so they join to one VCF."""
    parts.repartitionByRange("line_no", "part").sortWithinPartitions("line_no", "part").select("line").write.text(path)


def typed_info(info: Column, key: str, kind: str) -> Column:
    """An INFO value as an array of a type, or whether a flag is there."""
    if kind == "flag":
        return F.array_contains(F.split(info, ";"), key)
    return F.transform(F.split(strings.info_value(info, key), ","), lambda x: x.try_cast(kind))


def allele_counts_from_info(info: Column) -> tuple[Column, Column]:
    """AC as an array and AN."""
    return typed_info(info, "AC", "int"), typed_info(info, "AN", "int")[0]


def sample_columns(fields: Column, keep: list[int]) -> Column:
    """A record's fields with some samples only, by place."""
    return F.concat(F.slice(fields, 1, 9), *[F.slice(fields, 10 + k, 1) for k in keep]) if keep else F.slice(fields, 1, 8)
