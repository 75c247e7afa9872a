"""Copy-number intervals from clipped alignment ends, and the observations that they make unreliable.

An interval's balance is the clipped starts since it opened less the clipped ends, so any interval's balance is a
difference of two running sums. From the row where an interval opens, its fate is the first of a few events, which are
searched in whole stretches of rows. A quiet row, of fewer than five starts and ends and no fewer ends than starts,
opens nothing and closes nothing. After a gap of 200 kb nothing that is open survives it, and after one of 30 kb
nothing whose balance can't be deep, which the running sum's rise over its least value bounds: contigs are cut there
into parts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.ranges import BIN, point_join

# How long an interval waits for more clips, the longest one, the balance that lets it wait anew, starts of a steep one.
AREA, LONGEST, DEEP, STEEP = 30_000, 200_000, 30, 5
# Fixed values for a steep one by its peak of starts: below the first number, between them, from the second on.
PEAKS = (10, 20)
ENDS_BELOW, BALANCE_BELOW, BALANCE_ABOVE = 5, 2, 5
# For one that isn't: a balance above this closes by a fourth of it in ends, else by five ends.
HIGH, ENDS_ELSE = 20, 5


def _first(hits: np.ndarray) -> int:
    return int(hits.argmax()) if hits.any() else len(hits)


class _Part:
    """Rows (pos, front, back) of a part of a contig, with the running balance."""

    def __init__(self, pos: np.ndarray, front: np.ndarray, back: np.ndarray):
        self.pos, self.front, self.back = pos, front, back
        self.total = np.cumsum(front - back)

    def fate(self, start: int, row: int, base: int, peak: int | None, end: int) -> tuple[str, int, int]:
        """What ends the interval of the row ``start`` from ``row`` on, where, and the end that it then waits for. base: the running balance before it; peak: None for one that isn't steep."""
        size = 64
        while row < len(self.pos):
            s = slice(row, row + size)
            pos, front, back, balance = self.pos[s], self.front[s], self.back[s], self.total[s] - base
            ends = np.maximum.accumulate(np.where(balance > DEEP, pos + AREA, end))
            gone = (pos > ends) | (balance <= 0) | (pos - self.pos[start] >= LONGEST)
            if peak is None:
                before = balance - (front - back)
                closed = back >= np.where(before > HIGH, before // 4, ENDS_ELSE)
                # the order of events at one row: closed, replaced by a steep one, gone
                events = (("closed", closed), ("steeper", front >= STEEP), ("gone", gone))
            else:
                few = BALANCE_BELOW if peak < PEAKS[0] else peak // 4 if peak < PEAKS[1] else BALANCE_ABOVE
                closed = (back >= (ENDS_BELOW if peak < PEAKS[0] else peak // 2)) | ((balance <= few) & (pos <= ends))
                events = (("steeper", front > peak), ("closed", closed), ("gone", gone))
            at, _, what = min((_first(hits), k, name) for k, (name, hits) in enumerate(events))
            if at < len(pos):
                return what, row + at, int(ends[at - 1]) if at else end
            row, end, size = row + len(pos), int(ends[-1]), 4 * size
        return "open", row, end

    def intervals(self) -> list[tuple[int, int]]:
        opening = np.flatnonzero((self.front >= STEEP) | (self.front > self.back))
        found, row = [], 0
        while (k := np.searchsorted(opening, row)) < len(opening):
            start = int(opening[k])
            base, steep = int(self.total[start] - self.front[start] + self.back[start]), self.front[start] >= STEEP
            what, row, _ = self.fate(start, start + 1, base, int(self.front[start]) if steep else None, int(self.pos[start]) + AREA)
            while what == "steeper":
                fresh, start = not steep, row
                if fresh:  # a steep one takes the place of another kind and counts anew, from the next row on
                    base = int(self.total[row] - self.front[row] + self.back[row])
                steep = True
                what, row, _ = self.fate(start, row + fresh, base, int(self.front[start]), int(self.pos[start]) + AREA)
            if what == "closed":
                found.append((int(self.pos[start]), int(self.pos[row])))
            row += 1
        return found


def intervals_of(histogram: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Intervals of a contig's rows (pos, front, back), sorted by pos. The last row counts again 30 kb on."""
    if not histogram:
        return []
    last = histogram[-1]
    return _Part(*np.array([*histogram, (last[0] + AREA, *last[1:])], dtype=np.int64).T).intervals()


def parts(histogram: DataFrame) -> DataFrame:
    """The histogram with its contigs' last rows repeated 30 kb on, and the part of each row. Sums run over a contig, then over a stretch of it, in the JVM."""
    last = histogram.groupBy("chrom").agg(F.max_by(F.struct("pos", "front", "back"), "pos").alias("x")).select("chrom", (F.col("x.pos") + AREA).alias("pos"), "x.front", "x.back")
    h = histogram.select("chrom", F.col("pos").cast("long").alias("pos"), "front", "back").unionByName(last)
    w = Window.partitionBy("chrom").orderBy("pos")
    quiet = (F.col("front") < STEEP) & (F.col("back") < ENDS_ELSE) & (F.col("front") <= F.col("back"))
    h = h.withColumn("gap", F.when(quiet, F.col("pos") - F.lag("pos").over(w)))
    h = h.withColumn("stretch", F.count_if(F.col("gap") >= LONGEST).over(w))
    w = Window.partitionBy("chrom", "stretch").orderBy("pos")
    h = h.withColumn("total", F.sum(F.col("front") - F.col("back")).over(w))
    least = F.least(F.lit(0), F.min("total").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    h = h.withColumn("cut", (F.col("gap") > AREA) & (F.col("total") - least <= DEEP))
    return h.withColumn("part", F.count_if("cut").over(w)).select("chrom", "pos", "front", "back", "stretch", "part")


def cnv_intervals(histogram: DataFrame) -> DataFrame:
    """(chrom, start, end) from (chrom, pos, front, back), one row a clipped position. A part of a contig is one group. No rows: none."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        found = _Part(*(part[c].to_numpy(np.int64) for c in ("pos", "front", "back"))).intervals()
        return pd.DataFrame({"chrom": [part.chrom.iloc[0]] * len(found), "start": [a for a, _ in found], "end": [b for _, b in found]})

    return parts(histogram).groupBy("chrom", "stretch", "part").applyInPandas(run, "chrom long, start long, end long")


def miss_rates(obs: DataFrame, intervals: DataFrame, size: int = BIN) -> DataFrame:
    """(chrom, pos, sum and count of the reads' alternative counts by allele, miss_rate). A read counts where it has an alternative inside the interval."""
    i = intervals.select("chrom", "start", "end").distinct()
    x = point_join(i, obs.select("chrom", "read_id", "pos", "allele"), ["chrom"], "start", "end", "pos", size)
    per_read = x.groupBy("chrom", "start", "end", "read_id").agg(F.count_if(F.col("allele") == 1).alias("n_alt")).where("n_alt > 0")
    y = x.join(per_read, ["chrom", "start", "end", "read_id"])
    side = lambda a, f: f(F.when(F.col("allele") == a, F.col("n_alt")))
    g = y.groupBy("chrom", "pos").agg(side(0, F.sum).alias("ref_sum"), side(0, F.count).alias("ref_n"), side(1, F.sum).alias("alt_sum"), side(1, F.count).alias("alt_n"))
    ref, alt = F.try_divide(F.col("ref_sum").cast("double"), F.col("ref_n")), F.try_divide(F.col("alt_sum").cast("double"), F.col("alt_n"))
    return g.withColumn("miss_rate", F.try_divide(alt, ref + alt)).where("miss_rate is not null")


def without_misses(obs: DataFrame, rates: DataFrame, most: float = 0.7) -> DataFrame:
    return obs.join(rates.where(F.col("miss_rate") >= most).select("chrom", "pos"), ["chrom", "pos"], "left_anti")
