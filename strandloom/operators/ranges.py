"""Interval joins and merges. A range predicate alone would be a nested-loop join, so intervals are dealt to bins and
joined on the bin; each match is reported by one bin only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 1 << 14


def _bins(first: Column, last: Column, size: int) -> Column:
    return F.explode(F.sequence(F.floor(first / size), F.floor(last / size)))


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys under other names, so that sides of one origin stay apart."""
    return df.withColumnsRenamed({k: f"_k_{k}" for k in keys} | {"_bin": "_k_bin"})


def _same(keys: list[str]) -> Column:
    out = F.col("_bin") == F.col("_k_bin")
    for k in keys:
        out = out & (F.col(k) == F.col(f"_k_{k}"))
    return out


def point_join(intervals: DataFrame, points: DataFrame, keys: list[str], start: str, end: str, pos: str, size: int = BIN, how: str = "inner") -> DataFrame:
    """Intervals (start..end inclusive) with the points inside. A point is in one bin, so no match is doubled."""
    i = intervals.where(F.col(start) <= F.col(end)).withColumn("_bin", _bins(F.col(start), F.col(end), size))
    p = _renamed(points.withColumn("_bin", F.floor(F.col(pos) / size)), keys)
    out = i.join(p, _same(keys) & (F.col(pos) >= F.col(start)) & (F.col(pos) <= F.col(end)), how)
    return out.drop("_bin", "_k_bin", *[f"_k_{k}" for k in keys])


def points_within(points: DataFrame, intervals: DataFrame, keys: list[str], start: str, end: str, pos: str, size: int = BIN, anti: bool = False) -> DataFrame:
    """Points inside (anti: outside) any interval, each once."""
    i = intervals.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e")).where("_s <= _e").withColumn("_bin", _bins(F.col("_s"), F.col("_e"), size))
    p = points.withColumn("_bin", F.floor(F.col(pos) / size))
    on = _same(keys) & (F.col(pos) >= F.col("_s")) & (F.col(pos) <= F.col("_e"))
    return p.join(_renamed(i, keys), on, "left_anti" if anti else "left_semi").drop("_bin")


#: Bits by which bins of one level are larger than those of the level below.
LEVEL = 3


def _nested(first: Column, last: Column, levels: list[int]) -> Column:
    """(level, bin, own) of an interval at its own level, the least with bins as long as it is, and at all above: one or two bins a level, however long it is."""
    own = F.coalesce(*[F.when(last - first < F.lit(1 << k), F.lit(k)) for k in levels], F.lit(levels[-1]))
    at = lambda k, x: F.struct(F.lit(k).alias("level"), F.shiftright(x.cast("long"), k).alias("bin"), (own == k).alias("own"))
    return F.flatten(F.array(*[F.when(own <= k, F.array_distinct(F.array(at(k, first), at(k, last)))).otherwise(F.array().cast("array<struct<level:int,bin:bigint,own:boolean>>")) for k in levels]))


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], a_range: tuple[str, str], b_range: tuple[str, str], size: int = BIN, longest: int | None = None) -> DataFrame:
    """Pairs of overlapping intervals (ends inclusive). Column names must differ but for keys.

    Intervals are dealt to nested bins: each to the one or two bins that it touches at its own level and at every level above, up to that of the longest
    interval of either side (``longest``, or found by a pass over both). Two that overlap meet at the coarser of their own levels, so a pair has one level;
    of the bins that they share there, that of the later start reports it. Empty intervals and nulls have no pairs."""
    sides = [(a.where(F.col(a_range[0]) <= F.col(a_range[1])), a_range), (b.where(F.col(b_range[0]) <= F.col(b_range[1])), b_range)]
    if longest is None:
        longest = max((x.agg(F.max(F.col(r[1]) - F.col(r[0]))).first()[0] or 0) for x, r in sides)
    levels = [max(0, size.bit_length() - 1)]
    while 1 << levels[-1] <= longest:
        levels.append(levels[-1] + LEVEL)
    x, y = (df.withColumn(f"_{k}", F.explode(_nested(F.col(r[0]), F.col(r[1]), levels))) for k, (df, r) in zip("xy", sides))
    y = y.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = (F.col("_x.level") == F.col("_y.level")) & (F.col("_x.bin") == F.col("_y.bin")) & (F.col("_x.own") | F.col("_y.own"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    later = F.greatest(F.col(a_range[0]), F.col(b_range[0])).cast("long")
    here = F.coalesce(*[F.when(F.col("_x.level") == k, F.shiftright(later, k)) for k in levels]) == F.col("_x.bin")
    out = x.join(y, on & (F.col(a_range[0]) <= F.col(b_range[1])) & (F.col(b_range[0]) <= F.col(a_range[1])) & here)
    return out.drop("_x", "_y", *[f"_k_{k}" for k in keys])


def in_regions(rows: DataFrame, regions: DataFrame, keys: list[str], rows_range: tuple[str, str], start: str = "start", end: str = "end", size: int = BIN) -> DataFrame:
    """The rows of any table with intervals that overlap a region (keys, start, end; ends inclusive), each once. Regions are merged first; a row that overlaps
    several is reported by the first of them, which knows where the one before ends."""
    own = merge_intervals(regions.where(F.col(start) <= F.col(end)), keys, start, end)
    before = F.max(end).over(Window.partitionBy(*keys).orderBy(start).rowsBetween(Window.unboundedPreceding, -1))
    own = own.select(*keys, F.col(start).alias("_rs"), F.col(end).alias("_re"), before.alias("_before"))
    out = overlap_join(rows, own, keys, rows_range, ("_rs", "_re"), size)
    return out.where(F.col("_before").isNull() | (F.col("_before") < F.col(rows_range[0]))).drop("_rs", "_re", "_before")


def asof_forward(left: DataFrame, right: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    """left with ``value``: the first right position at or after pos, or null. Both sides are put in one order; no pairs are made."""
    names = left.columns
    a = left.select(*keys, F.col(pos).alias("_p"), F.lit(None).cast("long").alias("_v"), F.lit(1).alias("_side"), F.struct(*names).alias("_row"))
    b = right.select(*keys, F.col(value).alias("_p"), F.col(value).cast("long").alias("_v"), F.lit(2).alias("_side"), F.lit(None).cast(left.select(F.struct(*names).alias("s")).schema["s"].dataType).alias("_row")).distinct()
    # read backwards, so that the frame needs no buffer of what follows
    back = Window.partitionBy(*keys).orderBy(F.col("_p").desc(), F.col("_side").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return a.unionByName(b).withColumn(value, F.last("_v", ignorenulls=True).over(back)).where("_side = 1").select("_row.*", value)


def merge_intervals(intervals: DataFrame, keys: list[str], start: str, end: str, touching: int = 0) -> DataFrame:
    """Union of overlapping intervals; touching: how many positions may lie between two that still merge."""
    by = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    x = intervals.withColumn("_new", (reach.isNull() | (F.col(start) > reach + touching)).cast("int"))
    x = x.withColumn("_group", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*keys, "_group").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_group")


def runs(points: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Each point with the first position of its run of consecutive positions."""
    w = Window.partitionBy(*keys).orderBy(pos)
    x = points.withColumn("_g", F.col(pos) - F.row_number().over(w))
    return x.withColumn("representative", F.min(pos).over(Window.partitionBy(*keys, "_g"))).drop("_g")
