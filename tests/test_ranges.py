"""Joins of intervals by nested bins against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import ranges


def some(seed, n, name, far=100_000_000):
    r, out = random.Random(seed), []
    for k in range(n):
        a = r.choice([r.randrange(2_000), r.randrange(far), r.randrange(1 << 14, 1 << 15)])
        out.append((r.choice("ab"), f"{name}{k}", a, a + r.choice([0, 3, 50, 16_384, 70_000, -1])))
    return out + [("a", f"{name}long", 5, far), ("b", f"{name}edge", (1 << 20) - 1, 1 << 20), ("a", f"{name}null", None, 7), (None, f"{name}none", 1, 9), ("a", f"{name}long", 5, far)]


@pytest.mark.parametrize("size", [1, 64, 1 << 14])
def test_all_pairs(spark, size):
    a, b = some(1, 150, "x"), some(2, 120, "y")
    want = sorted((p[1], q[1]) for p in a for q in b if None not in (*p, *q) and p[0] == q[0] and p[2] <= p[3] and q[2] <= q[3] and p[2] <= q[3] and q[2] <= p[3])
    x, y = spark.createDataFrame(a, "chrom string, x string, s1 long, e1 long"), spark.createDataFrame(b, "chrom string, y string, s2 long, e2 long")
    got = ranges.overlap_join(x, y, ["chrom"], ("s1", "e1"), ("s2", "e2"), size)
    assert got.columns == ["chrom", "x", "s1", "e1", "y", "s2", "e2"]
    assert sorted((r.x, r.y) for r in got.collect()) == want
    assert ranges.overlap_join(x.where("false"), y, ["chrom"], ("s1", "e1"), ("s2", "e2"), size).count() == 0
    hit = ranges.in_regions(x, y.withColumnsRenamed({"s2": "start", "e2": "end"}).where("y <> 'ylong'"), ["chrom"], ("s1", "e1"), size=size)
    assert sorted(r.x for r in hit.collect()) == sorted(p[1] for p in a if None not in p and any(None not in q and q[1] != "ylong" and p[0] == q[0] and p[2] <= p[3] and q[2] <= q[3] and p[2] <= q[3] and q[2] <= p[3] for q in b))


def test_long_intervals_take_few_rows(spark):
    x = spark.createDataFrame([(0, 100_000_000), (7, 7), (16_380, 16_390)], "s long, e long")
    levels = list(range(14, 30, 3))
    n = x.select(F.size(ranges._nested(F.col("s"), F.col("e"), levels)).alias("n")).collect()
    assert [r.n for r in n] == [1, 6, 7]  # one bin at each level from its own, and two where one ends within
