"""Column functions on sequences, VCF fields, regions, genotypes and alleles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def run_length(seq: Column, pos: Column, cap: int = 10) -> Column:
    """Length of the run of one base around a 0-based position, at most cap; 1 at the last base. The left side is counted first."""
    base = F.substring(seq, (pos + 1).cast("int"), F.lit(1))
    left = F.reverse(F.substring(seq, F.greatest(pos - cap, F.lit(0)).cast("int") + 1, F.least(pos, F.lit(cap)).cast("int")))
    right = F.substring(seq, (pos + 2).cast("int"), F.lit(cap))
    same = lambda s: F.length(s) - F.length(F.ltrim(s, base))
    return F.when(pos + 1 >= F.length(seq), 1).otherwise(F.least(F.lit(cap), 1 + same(left) + same(right)))


def repeat_after(seq: Column, pos: Column, times: int = 5) -> Column:
    """Whether the two bases after a position repeat at least ``times`` times in a row."""
    two = F.substring(seq, (pos + 2).cast("int"), F.lit(2))
    return (F.length(two) == 2) & (F.substring(seq, (pos + 2).cast("int"), F.lit(2 * times)) == F.repeat(two, F.lit(times)))


def field(format_: Column, sample: Column, key: str) -> Column:
    """A sample's value of a FORMAT key; null where the key is missing."""
    at = F.array_position(F.split(format_, ":"), key).cast("int")
    return F.when(at > 0, F.try_element_at(F.split(sample, ":"), F.when(at > 0, at)))


def set_field(format_: Column, sample: Column, key: str, value: Column) -> Column:
    keys = F.split(format_, ":")
    return F.array_join(F.transform(F.split(sample, ":"), lambda x, k: F.when(F.try_element_at(keys, k + 1) == key, value).otherwise(x)), ":")


def without_field(format_: Column, sample: Column, key: str) -> tuple[Column, Column]:
    """FORMAT and sample without a key."""
    keys = F.split(format_, ":")
    kept = F.filter(F.split(sample, ":"), lambda x, k: F.coalesce(F.try_element_at(keys, k + 1) != key, F.lit(True)))
    return F.array_join(F.filter(keys, lambda x: x != key), ":"), F.array_join(kept, ":")


def unphased(gt: Column) -> Column:
    """Alleles sorted, separated by a slash."""
    return F.array_join(F.array_sort(F.split(gt, r"[/|]")), "/")


def info_value(info: Column, key: str) -> Column:
    v = F.regexp_extract(info, rf"(?:^|;){key}=([^;]*)", 1)
    return F.when(v != "", v)


def svlen(info: Column) -> Column:
    return info_value(info, "SVLEN").try_cast("long")


def between(text: Column, start: str, end: str) -> Column:
    """What lies between the first start and the first end after it."""
    return F.substring_index(F.substring(text, F.instr(text, start) + len(start), F.length(text)), end, 1)


def info_list(key: str, names: Column) -> Column:
    return F.concat(F.lit(f"{key}="), F.array_join(names, ","), F.lit(";"))


def variant_type(ref: Column, alt: Column) -> Column:
    """(type, n): REF, SNP, MNP, INS, DEL, OTHER, BND or OVERLAP, and the length by which the alternative differs. Case doesn't matter."""
    r, a = F.upper(ref), F.upper(alt)
    nr, na = F.length(r), F.length(a)
    agree = lambda x, y: F.coalesce(F.array_min(F.filter(F.sequence(F.lit(1), F.least(nr, na) + 1), lambda k: F.substring(x, k, F.lit(1)) != F.substring(y, k, F.lit(1)))), F.least(nr, na) + 1) - 1
    pre = agree(r, a)
    suf = F.least(agree(F.reverse(r), F.reverse(a)), F.least(nr, na) - pre)
    left_r, left_a = nr - pre - suf, na - pre - suf
    one = lambda t, n=F.lit(0): F.struct(F.lit(t).alias("type"), n.cast("int").alias("n"))
    single = (nr == 1) & (na == 1)
    return (
        F.when(alt == "*", one("OVERLAP"))
        .when(single & (alt.isin(".", "X") | (ref == alt)), one("REF"))
        .when(single, one("SNP", F.lit(1)))
        .when(alt.isin("<X>", "<*>", "<NON_REF>"), one("REF"))
        .when(F.startswith(alt, F.lit("<")), one("OTHER"))
        .when(alt.rlike(r"^[\[\]]"), one("BND"))
        .when((pre == nr) & (na > nr) & F.substring(alt, pre + 1, F.lit(1)).isin("[", "]"), one("BND"))
        .when((left_r == 0) & (left_a == 0), one("REF"))
        .when(left_r == 0, one("INS", na - nr))
        .when(left_a == 0, one("DEL", na - nr))
        .when((left_r == 1) & (left_a == 1), one("SNP", F.lit(1)))
        .when(left_r == left_a, one("MNP", left_a))
        .otherwise(one("OTHER", F.when(left_a == 1, 1 - left_r).when(left_r == 1, left_a - 1).when(left_r > left_a, -left_r).otherwise(left_a)))
    )


def genotype_class(gt: Column) -> Column:
    """HOM_RR, HET_RA, HOM_AA, HET_AA, HAPL_R, HAPL_A or UNKN."""
    al = F.split(gt, r"[/|]")
    alts = F.array_distinct(F.filter(al, lambda x: x != "0"))
    ref = F.exists(al, lambda x: x == "0")
    return (
        F.when(gt.isNull() | (gt == "") | F.exists(al, lambda x: (x == ".") | (x == "")), "UNKN")
        .when(F.size(al) == 1, F.when(ref, "HAPL_R").otherwise("HAPL_A"))
        .when(~ref, F.when(F.size(alts) == 1, "HOM_AA").otherwise("HET_AA"))
        .when(F.size(alts) == 0, "HOM_RR")
        .otherwise("HET_RA")
    )


def allele_counts(gt: Column, n_alleles: int) -> Column:
    """Array of counts by allele over a genotype; missing alleles don't count."""
    al = F.split(gt, r"[/|]")
    return F.array(*[F.size(F.filter(al, _is(str(k)))) for k in range(n_alleles)])


def _is(v: str):
    return lambda x: x == v


def region(text: Column) -> Column:
    """(chrom, start, end) of 'chrom', '{chrom}', 'chrom:start' or 'chrom:start-end', 1-based inclusive, thousands separators allowed; the end is null where open."""
    m = r"^\s*(?:\{([^}]*)\}|([^:]*))(?::([0-9,]+)(?:-([0-9,]*))?)?\s*$"
    num = lambda g: F.regexp_replace(F.regexp_extract(text, m, g), ",", "").try_cast("long")
    name = F.concat(F.regexp_extract(text, m, 1), F.regexp_extract(text, m, 2))
    return F.when(text.rlike(m), F.struct(name.alias("chrom"), F.coalesce(num(3), F.lit(1).cast("long")).alias("start"), num(4).alias("end")))


# Names of the alignment flag's bits, from the lowest.
FLAG_NAMES = ("PAIRED", "PROPER_PAIR", "UNMAP", "MUNMAP", "REVERSE", "MREVERSE", "READ1", "READ2", "SECONDARY", "QCFAIL", "DUP", "SUPPLEMENTARY")


def flag_names(flag: Column) -> Column:
    """Comma-joined names of the bits that are set."""
    return F.concat_ws(",", *[F.when(flag.bitwiseAND(1 << k) != 0, F.lit(n)) for k, n in enumerate(FLAG_NAMES)])


def flag_of(names: Column) -> Column:
    """The flag of comma-joined names."""
    have = F.split(names, ",")
    total = F.lit(0)
    for k, n in enumerate(FLAG_NAMES):
        total = total + F.when(F.array_contains(have, n), 1 << k).otherwise(0)
    return total
