"""Overlapping alignments of one read.

An alignment meets the kept ones before it, latest first. It wins against one that it resembles and outlasts, loses
against one that holds it or that it resembles without being longer, and rests at the first that it does neither to.
Two alignments resemble each other when their common variants' range is a given part of the range of both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<place:int,first:long,last:long>"


def _meetings(kept: Column, x: Column, bound: Column, threshold: float) -> tuple[Column, Column]:
    """For every kept span, whether x wins and whether it loses. bound: where the range to compare with the latest one ends."""

    def each(s: Column, place: Column) -> Column:
        end = F.when(place == 0, bound).otherwise(s["last"])
        touching, held = x["first"] <= end, x["last"] < end
        common = F.least(s["last"], x["last"]) - F.greatest(s["first"], x["first"]) + 1
        alike = common / (F.greatest(s["last"], x["last"]) - F.least(s["first"], x["first"]) + 1) >= threshold
        longer = x["last"] - x["first"] > s["last"] - s["first"]
        return F.struct((touching & ~held & (common > 0) & alike & longer).alias("won"), (touching & (held | ((common > 0) & alike & ~longer))).alias("lost"))

    met = F.transform(kept, each)
    return F.transform(met, lambda m: m["won"]), F.transform(met, lambda m: m["lost"])


def dropped(spans: Column, threshold: float = 0.2) -> Column:
    """Places, from 0, of the spans (first, last) to drop of an array in scan order. Native: a fold whose state is the kept spans, latest first."""
    at = F.transform(spans, lambda s, k: F.struct(k.cast("int").alias("place"), s["first"].cast("long").alias("first"), s["last"].cast("long").alias("last")))
    state = "struct<kept:array<struct<place:int,first:long,last:long>>,bound:long,gone:array<int>>"
    none = F.struct(F.array().cast(f"array<{SPAN}>").alias("kept"), F.lit(None).cast("long").alias("bound"), F.array().cast("array<int>").alias("gone")).cast(state)

    def step(acc: Column, x: Column) -> Column:
        won, lost = _meetings(acc["kept"], x, acc["bound"], threshold)
        stop = F.array_position(won, F.lit(False)).cast("int")
        beaten = F.when(stop > 0, stop - 1).otherwise(F.size(acc["kept"]))
        out = F.struct(beaten.alias("n"), F.coalesce(F.get(lost, beaten), F.lit(False)).alias("goes"))
        # the decision is bound by a one-row transform, so that it is evaluated once
        nxt = lambda d: F.struct(
            F.concat(F.when(d["goes"], F.array().cast(f"array<{SPAN}>")).otherwise(F.array(x)), F.slice(acc["kept"], d["n"] + 1, F.size(acc["kept"]))).alias("kept"),
            x["last"].alias("bound"),
            F.concat(acc["gone"], F.transform(F.slice(acc["kept"], F.lit(1), d["n"]), lambda s: s["place"]), F.when(d["goes"], F.array(x["place"])).otherwise(F.array().cast("array<int>"))).alias("gone"),
        )
        return F.get(F.transform(F.array(out), nxt), F.lit(0)).cast(state)

    return F.array_sort(F.aggregate(at, none, step, lambda a: a["gone"]))


def without_overlaps(obs: DataFrame, threshold: float = 0.2) -> DataFrame:
    """obs: (chrom, aln_id, read_id, ...) without those of dropped alignments. One row an alignment is shuffled, then one a read, whose array is as long as the read has alignments."""
    aln = obs.groupBy("chrom", "read_id", "aln_id").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    reads = aln.groupBy("chrom", "read_id").agg(F.array_sort(F.collect_list(F.struct("aln_id", "first", "last"))).alias("spans")).where(F.size("spans") > 1)
    bad = reads.select("chrom", "spans", F.explode(dropped(F.col("spans"), threshold)).alias("k")).select("chrom", F.get("spans", F.col("k"))["aln_id"].alias("aln_id"))
    return obs.join(bad, ["chrom", "aln_id"], "left_anti")
