"""Pileup of several files with insertions, and qualities of mates that overlap.

Operations of reads are cut at the ends of windows of a contig and dealt by (contig, window), so the shuffle carries
stretches of bases, not columns; inside a window they are laid out position by position and gathered. What a column
shows of a read beyond its window (head, tail, what is inserted or deleted behind it) travels with the stretch.

Defined results: reads that are unmapped or have no CIGAR cover nothing; without a sequence bases are ``N``; an
insertion before the first reference base is not shown; padding counts in an insertion only beside inserted bases;
reads of one column keep the order given; an empty table gives no columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators import cigar

#: Positions of a window.
WINDOW = 1 << 12


def stretches(reads: DataFrame, keep: list[str], window: int = WINDOW) -> DataFrame:
    """One row a reference operation and window: keep, window, pos, len, op, bases (of M, = and X), and for the last stretch of an
    operation ins, the bases and pads inserted behind it, and del_len, the deletion that follows; head and tail tell a read's first and last one."""
    ops = cigar.parse(F.col("cigar"))
    used = lambda x, *kinds: F.when(x["op"].isin(*kinds), x["len"]).otherwise(F.lit(0).cast("long"))
    x = reads.where(F.col("flag").bitwiseAND(4) == 0).select(*keep, "pos", "seq", ops.alias("_ops"))
    # where each operation begins on the reference and on the read
    zero = F.struct(F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("q"), F.array().cast("array<struct<op:string,len:bigint,r:bigint,q:bigint>>").alias("out"))
    step = lambda a, o: F.struct(
        (a["r"] + used(o, *cigar.BOTH, *cigar.REF)).alias("r"), (a["q"] + used(o, *cigar.BOTH, *cigar.QUERY)).alias("q"),
        F.array_append(a["out"], F.struct(o["op"].alias("op"), o["len"].alias("len"), a["r"].alias("r"), a["q"].alias("q"))).alias("out"),
    )
    x = x.withColumn("_ops", F.aggregate("_ops", zero, step, lambda a: a["out"]))
    x = x.withColumn("_ref", F.filter(F.transform("_ops", lambda o, k: F.struct(k.alias("k"), o.alias("o"))), lambda y: y["o"]["op"].isin(*cigar.BOTH, *cigar.REF) & (y["o"]["len"] > 0)))
    x = x.select(*keep, "pos", "seq", "_ops", "_ref", F.posexplode("_ref").alias("_j", "_x"))
    after = F.try_element_at("_ref", F.col("_j") + 2)
    run = F.slice("_ops", F.col("_x.k") + 2, F.coalesce(after["k"], F.size("_ops")) - F.col("_x.k") - 1)
    run = F.filter(run, lambda o: o["op"].isin("I", "P"))
    bases = lambda at, n: F.when(F.coalesce("seq", F.lit("*")) == "*", F.repeat(F.lit("N"), n)).otherwise(F.substring("seq", at.cast("int") + 1, n))
    shown = F.array_join(F.transform(run, lambda o: F.when(o["op"] == "P", F.repeat(F.lit("*"), o["len"].cast("int"))).otherwise(bases(o["q"], o["len"].cast("int")))), "")
    x = x.select(
        *keep, "seq", (F.col("pos") + F.col("_x.o.r")).alias("_s"), F.col("_x.o.len").alias("_n"), F.col("_x.o.op").alias("op"), F.col("_x.o.q").alias("_q"),
        F.when(F.exists(run, lambda o: o["op"] == "I"), shown).otherwise("").alias("ins"), F.when(after["o"]["op"] == "D", after["o"]["len"]).otherwise(F.lit(0)).alias("del_len"),
        (F.col("_j") == 0).alias("head"), after.isNull().alias("tail"),
    )
    end = F.col("_s") + F.col("_n")
    x = x.select("*", F.explode(F.sequence(F.floor(F.col("_s") / window), F.floor((end - 1) / window))).alias("window"))
    lo, hi = F.greatest("_s", F.col("window") * window), F.least(end, (F.col("window") + 1) * window)
    first, last = lo == F.col("_s"), hi == end
    own = F.when(F.col("op").isin(*cigar.BOTH), bases(F.col("_q") + lo - F.col("_s"), (hi - lo).cast("int")))
    return x.select(
        *keep, "window", lo.alias("pos"), (hi - lo).alias("len"), "op", own.alias("bases"), F.when(last, F.col("ins")).otherwise("").alias("ins"),
        F.when(last, F.col("del_len")).otherwise(F.lit(0)).alias("del_len"), (F.col("head") & first).alias("head"), (F.col("tail") & last).alias("tail"),
    )


def cell(base: Column, ins: Column, del_len: Column, head: Column, tail: Column, mapq: Column) -> Column:
    """A read in a column: ^ and its mapping quality at its head, the base (* deleted, > skipped), what is inserted and deleted behind it, $ at its tail."""
    return F.concat(
        F.when(head, F.concat(F.lit("^"), F.chr(F.least(mapq, F.lit(93)) + 33))).otherwise(""), base,
        F.when(ins != "", F.concat(F.lit("+"), F.length(ins).cast("string"), F.lit("("), ins, F.lit(")"))).otherwise(""),
        F.when(del_len > 0, F.concat(F.lit("-"), del_len.cast("string"), F.lit("()"))).otherwise(""), F.when(tail, "$").otherwise(""),
    )


def columns(reads: DataFrame, files: int, chrom: str = "chrom", order: str = "aln_id", window: int = WINDOW, partitions: int | None = None) -> DataFrame:
    """(chrom, pos, depths, texts): by covered position, the depth and the cells of each of ``files`` files, in order of their reads.
    reads: (chrom, file from 0, order, pos, mapq, flag, cigar, seq)."""
    s = stretches(reads.withColumn("mapq", F.coalesce("mapq", F.lit(0))), [chrom, "file", order, "mapq"], window)
    n = partitions or int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = s.repartition(n, chrom, "window")  # the grouping by position below needs no further shuffle
    x = s.select("*", F.explode(F.sequence(F.lit(0), F.col("len").cast("int") - 1)).alias("_k"))
    last = F.col("_k") == F.col("len") - 1
    base = F.when(F.col("op") == "D", "*").when(F.col("op") == "N", ">").otherwise(F.substring("bases", F.col("_k") + 1, F.lit(1)))
    shown = cell(base, F.when(last, F.col("ins")).otherwise(""), F.when(last, F.col("del_len")).otherwise(F.lit(0)), F.col("head") & (F.col("_k") == 0), F.col("tail") & last, F.col("mapq").cast("int"))
    x = x.select(chrom, "window", (F.col("pos") + F.col("_k")).alias("pos"), "file", F.struct(F.col(order).alias("o"), shown.alias("c")).alias("x"))
    got = x.groupBy(chrom, "window", "pos").agg(*[F.array_sort(F.collect_list(F.when(F.col("file") == k, F.col("x")))).alias(f"_{k}") for k in range(files)])
    return got.select(
        chrom, "pos", F.array(*[F.size(f"_{k}").cast("long") for k in range(files)]).alias("depths"),
        F.array(*[F.array_join(F.transform(f"_{k}", lambda x: x["c"]), "") for k in range(files)]).alias("texts"),
    )


def _places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Reference and read places of the aligned bases of a CIGAR, from 0."""
    import re

    ops = [(int(n), op) for n, op in re.findall(cigar.OP, text or "")]
    n, kind = np.array([o[0] for o in ops], np.int64), np.array([o[1] for o in ops])
    both = np.isin(kind, cigar.BOTH)
    ref, query = np.cumsum(n * (both | np.isin(kind, cigar.REF))), np.cumsum(n * (both | np.isin(kind, cigar.QUERY)))
    within = np.concatenate([np.arange(k) for k in n[both]] or [np.zeros(0, np.int64)])
    return np.repeat((ref - n)[both], n[both]) + within, np.repeat((query - n)[both], n[both]) + within


#: Places of short CIGARs, which come again and again.
_known_places = lru_cache(1 << 12)(_places)


class _Side:
    """One mate of each of a batch of pairs: aligned bases in order of (pair, reference place), bases and qualities."""

    def __init__(self, pos: pa.Array, text: pa.Array, seq: pa.Array, qual: pa.Array):
        found = [_known_places(t) if len(t) < 100 else _places(t) for t in text.to_pylist()]
        size = np.array([len(r) for r, _ in found], np.int64)
        self.pair = np.repeat(np.arange(len(found)), size)
        self.ref = np.concatenate([r for r, _ in found]) + np.repeat(pos.to_numpy(zero_copy_only=False).astype(np.int64), size)
        self.query = np.concatenate([q for _, q in found])
        self.offsets = np.concatenate([[0], np.cumsum(qual.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
        self.qual = qual.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.bases = np.frombuffer("".join(seq.to_pylist()).encode("latin-1", "replace"), np.uint8)

    def at(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in bases and qualities of aligned bases, and which of them the read has."""
        begin = self.offsets[self.pair[k]]
        return begin + self.query[k], begin + self.query[k] < self.offsets[self.pair[k] + 1]


def _common(a: _Side, b: _Side) -> tuple[np.ndarray, np.ndarray]:
    """Aligned bases of both sides at the same place of the same pair."""
    low = min(a.ref.min(initial=0), b.ref.min(initial=0))
    span = max(a.ref.max(initial=0), b.ref.max(initial=0)) - low + 1
    if span * (1 + max(a.pair.max(initial=0), b.pair.max(initial=0))) >= 1 << 62:
        raise ValueError("positions are too far apart")
    x, y = a.pair * span + a.ref - low, b.pair * span + b.ref - low
    k = np.minimum(np.searchsorted(y, x), max(0, len(y) - 1))
    same = y[k] == x if len(y) else np.zeros(len(x), bool)
    return np.flatnonzero(same), k[same]


def agreed(a: _Side, b: _Side, wins: np.ndarray) -> np.ndarray:
    """Qualities of the mates ``a`` after their overlap with ``b``: at a common position equal bases have the sum (200 at most)
    in one mate, others four fifths of the higher quality in that mate, and the other mate has 0; wins: which pairs' ties and equal bases go to ``a``."""
    ka, kb = _common(a, b)
    (own, has), (other, there) = a.at(ka), b.at(kb)
    good = has & there
    own, other, tie = own[good], other[good], wins[a.pair[ka[good]]]
    x, y = a.qual[own], b.qual[other]
    same = a.bases[own] == b.bases[other]
    won = np.where(same | (x == y), tie, x > y)
    out = a.qual.copy()
    out[own] = np.where(won, np.where(same, np.minimum(x + y, 200), np.maximum(x, y) * 4 // 5), 0)
    return out


def overlaps_resolved(reads: DataFrame, keys: list[str], chrom: str = "chrom", order: str = "aln_id") -> DataFrame:
    """reads with ``qual`` (array of int) of overlapping mates mended: of a base that both mates show only one keeps a quality.
    reads: (keys, chrom, order, qname, flag, pos, cigar, seq, qual). Mates: two primary reads of one name, both mapped, properly paired, on one contig.
    A name with more such reads is left as it is. The mate that keeps equal bases follows from a hash of the name.
    Each read meets its mate by one shuffle of the reads and takes it along."""
    mate = (F.col("flag").bitwiseAND(0x1 | 0x2 | 0x4 | 0x8 | 0x100 | 0x800) == 0x3) & F.col("seq").isNotNull() & (F.col("seq") != "*") & (F.size("qual") == F.length("seq"))
    group = [*keys, chrom, "qname"]
    named = mate
    for k in group:
        named = named & F.col(k).isNotNull()
    read = reads.withColumn("qual", F.col("qual").cast("array<int>"))
    end = cigar.end_position(F.col("pos"), F.col("cigar"), F.col("flag"))
    # reads that have no mate go anywhere; the read is one column, so that its own names don't meet those used here
    own = F.struct("pos", "cigar", "seq", "qual", end.alias("end"))
    x = read.select(F.struct("*").alias("r"), F.when(named, own).alias("own"), F.struct(*group, F.when(named, F.lit(0).cast("long")).otherwise(F.xxhash64(order)).alias("_alone")).alias("name"), F.col(order).alias("id"))
    by = Window.partitionBy("name")
    x = x.withColumn("n", F.count("*").over(by)).withColumn("before", F.lag("own").over(by.orderBy("own.pos", "id"))).withColumn("after", F.lead("own").over(by.orderBy("own.pos", "id")))
    other = F.coalesce("before", "after")
    met = F.col("own").isNotNull() & (F.col("n") == 2) & (F.least("own.end", other["end"]) > F.greatest("own.pos", other["pos"]))
    first = F.substring(F.md5(F.col("r.qname").cast("binary")), 1, 1) < "8"
    x = x.select("r", F.when(met, other.dropFields("end")).alias("other"), (first == F.col("before").isNull()).alias("wins"))
    names = read.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, met = b.column(0).flatten(), b.column(1).is_valid()
            old = made[names.index("qual")]
            if pc.any(met).as_py():
                t = b.filter(met)
                own, wins = t.column(0).flatten(), t.column(2).to_numpy(zero_copy_only=False).astype(bool)
                mine, its = _Side(*[own[names.index(c)] for c in ("pos", "cigar", "seq", "qual")]), _Side(*t.column(1).flatten())
                new = pa.ListArray.from_arrays(pa.array(mine.offsets, pa.int32()), pa.array(agreed(mine, its, wins), pa.int32()))
                at = pc.replace_with_mask(pa.array(np.arange(len(met)), pa.int64()), met, pa.array(len(met) + np.arange(len(new)), pa.int64()))
                made[names.index("qual")] = pa.concat_arrays([old.cast(new.type), new]).take(at)
            yield pa.RecordBatch.from_arrays(made, names=names)

    return x.mapInArrow(run, read.schema)
