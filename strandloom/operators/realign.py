"""A cap on mapping qualities by the mismatches of an alignment.

The cap falls with the qualities of mismatching bases, beyond what so many mismatches in so many bases make likely, and
with the qualities of clipped ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions.alleles import let
from strandloom.operators.cigar import BOTH, placed

# Least quality that counts, most that a mismatch weighs, quality of a hard-clipped base, a fifth of clipped qualities, 10 / ln 10 as rounded in results.
LEAST, MOST, HARD, CLIPPED, PHRED = 13, 33, 13, 5.0, 4.343
CODES = "=ACMGRSVTWYHKDB"


def _bases(text: Column) -> Column:
    """Array of the text's bases in one alphabet; what is none is N."""
    return F.transform(F.split(F.upper(text), ""), lambda b: F.when(b == "U", "T").when(F.contains(F.lit(CODES), b), b).otherwise("N"))


def mapping_quality_cap(cigar: Column, seq: Column, qual: Column, ref: Column, threshold: int = 40) -> Column:
    """The cap, or -1 where mismatches say that the place is wrong. qual: array of numbers; ref: the reference from the alignment's first
    position on. Where it ends, the walk ends: later operations, clips too, don't count. A null in any gives null; a negative threshold is 40."""
    threshold = 40 if threshold < 0 else threshold
    read = F.struct(_bases(seq).alias("own"), qual.alias("qual"), _bases(ref).alias("there"), F.length(ref).alias("end"), placed(cigar).alias("ops"))
    given = cigar.isNotNull() & seq.isNotNull() & qual.isNotNull() & ref.isNotNull()
    return F.when(given, let(read, lambda r: _cap(r, threshold)))


def _cap(read: Column, threshold: int) -> Column:
    qual = read["qual"]

    def bases(op: Column) -> Column:
        """(quality, whether it differs) of the bases that count in a stretch of matches."""
        n = F.least(op["len"], read["end"] - op["r"])
        one = lambda k: F.struct(F.get(qual, (op["q"] + k).cast("int")).alias("qual"), F.get(read["own"], (op["q"] + k).cast("int")).alias("own"), F.get(read["there"], (op["r"] + k).cast("int")).alias("there"))
        at = F.when(op["op"].isin(*BOTH) & (n > 0), F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.filter(F.transform(at, one), lambda b: (b["qual"] >= LEAST) & (b["own"] != "N") & (b["there"] != "N"))

    def clipped(op: Column) -> Column:
        soft = F.aggregate(F.slice(qual, (op["q"] + 1).cast("int"), op["len"].cast("int")), F.lit(0).cast("long"), lambda a, x: a + x)
        return F.when(op["op"] == "H", HARD * op["len"]).when(op["op"] == "S", soft).otherwise(F.lit(0).cast("long"))

    def total(values: Column, of) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + of(x))

    def walked(ops: Column) -> Column:
        cut = F.array_position(F.transform(ops, lambda x: x["op"].isin(*BOTH, "D") & (x["r"] + x["len"] > read["end"])), F.lit(True)).cast("int")
        return F.struct(F.when(cut > 0, F.slice(ops, F.lit(1), cut - 1)).otherwise(ops).alias("whole"), F.when(cut > 0, F.slice(ops, F.lit(1), cut)).otherwise(ops).alias("all"))

    def sums(w: Column) -> Column:
        return let(F.flatten(F.transform(w["all"], bases)), lambda b: F.struct(
            (total(F.filter(w["whole"], lambda x: x["op"].isin(*BOTH)), lambda x: x["len"]) + F.size(b)).alias("n"), total(w["whole"], clipped).alias("clip"),
            F.transform(F.filter(b, lambda x: (x["own"] != "=") & (x["own"] != x["there"])), lambda x: F.least(x["qual"].cast("long"), F.lit(MOST).cast("long"))).alias("off")))

    def cap(s: Column) -> Column:
        many = F.size(s["off"])
        chance = F.aggregate(F.when(many > 0, F.sequence(F.lit(1), many)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, k: a + F.log(s["n"].cast("double") / k))
        t = total(s["off"], lambda x: x) - PHRED * chance + s["clip"] / CLIPPED
        return let(t, lambda t: F.when(t > threshold, -1).when(t.isNotNull(), F.floor(F.sqrt((threshold - F.greatest(t, F.lit(0.0))) / threshold) * threshold + 0.499).cast("int")))

    return let(let(let(read["ops"], walked), sums), cap)
