"""Removal of alleles against a model that lists genotypes."""

import random
from itertools import combinations_with_replacement

from pyspark.sql import functions as F

from strandloom.functions import alleles

INFO, FORMATS = {"AC": "A", "AD": "R", "GL": "G"}, {"AD": "R", "PL": "G", "EC": "A"}


def _genotypes(n, ploidy):
    return sorted(combinations_with_replacement(range(n), ploidy), key=lambda g: g[::-1])


def _model(fields, drop):
    alts = fields[4].split(",")
    n = len(alts) + 1
    stay = [k for k in range(n) if k == 0 or k not in drop]
    if len(stay) == n:
        return fields

    def picked(text, number, ploidies):
        v = text.split(",")
        lists = {"A": [[(k,) for k in range(1, n)]], "R": [[(k,) for k in range(n)]], "G": [_genotypes(n, p) for p in ploidies]}[number]
        for x in lists:
            if len(x) == len(v) and text != ".":
                return ",".join(a for a, g in zip(v, x) if set(g) <= set(stay)) or "."
        return text

    out = list(fields)
    out[4] = ",".join(alts[k - 1] for k in stay[1:]) or "."
    out[7] = ";".join(e if "=" not in e or e.split("=")[0] not in INFO else f"{e.split('=')[0]}={picked(e.split('=')[1], INFO[e.split('=')[0]], [2])}" for e in fields[7].split(";"))
    for s in range(9, len(fields)):
        cells = []
        for key, v in zip(fields[8].split(":"), fields[s].split(":")):
            if key == "GT":
                v = "".join(c if c in "/|." else str(stay.index(int(c))) if int(c) in stay else "." for c in v)
            cells.append(picked(v, FORMATS[key], [1, 2, 3, 4]) if key in FORMATS else v)
        out[s] = ":".join(cells)
    return out


def _record(r):
    n = r.randrange(2, 6)
    values = lambda k: ",".join(str(r.randrange(99)) for _ in range(k))
    info = [f"DP={r.randrange(9)}", "DB", "AC=" + values(n - 1), r.choice(["AD=" + values(n), "AD=."]), "GL=" + values(n * (n + 1) // 2)]
    samples = []
    for _ in range(r.randrange(4)):
        p = r.randrange(1, 5)
        gt = str(r.randrange(n)) + "".join(r.choice("/|") + r.choice([str(r.randrange(n)), "."]) for _ in range(p - 1))
        samples.append(":".join([gt, values(n), r.choice([values(len(_genotypes(n, p))), "."]), values(n - 1), "7"]))
    return ["1", str(r.randrange(999)), ".", "A", ",".join("A" + "CGTA"[k] * (k + 1) for k in range(n - 1)), ".", ".", ";".join(info), "GT:AD:PL:EC:DP", *samples]


def test_alleles_are_removed_as_in_a_model(spark):
    r = random.Random(9)
    rows = [(k, _record(r), [x for x in range(6) if r.random() < 0.4]) for k in range(300)] + [(300, _record(r), None)]
    df = spark.createDataFrame(rows, "k int, fields array<string>, drop array<int>")
    got = {x.k: (x.a, x.b) for x in df.select("k", alleles.without_alleles(F.col("fields"), F.col("drop"), INFO, FORMATS).alias("a"), alleles.trimmed(F.col("fields"), INFO, FORMATS).alias("b")).collect()}
    for k, fields, drop in rows:
        assert got[k][0] == _model(fields, drop or [])
        held = {c for s in fields[9:] for c in s.split(":")[0] if c.isdigit()}
        n = len(fields[4].split(",")) + 1
        assert got[k][1] == _model(fields, [a for a in range(1, n) if str(a) not in held] if len(fields) > 9 else [])


def test_records_without_alternatives_or_samples(spark):
    rows = [(["1", "5", ".", "A", ".", ".", ".", "DP=1"], [1]), (["1", "5", ".", "A", "C", ".", ".", "AC=3;DB"], [1]), (None, [1])]
    df = spark.createDataFrame(rows, "fields array<string>, drop array<int>")
    got = [x.f for x in df.select(alleles.without_alleles(F.col("fields"), F.col("drop"), INFO, FORMATS).alias("f")).collect()]
    assert got == [rows[0][0], ["1", "5", ".", "A", ".", ".", ".", "AC=.;DB"], None]


def test_many_alleles(spark):
    """Thirty-one alleles have 376,992 genotypes of ploidy 5: their flags are not made where the values are of ploidy 2."""
    alts, n = ["A" * k + "C" for k in range(30)], 496
    rows = [(["1", "5", ".", "A", ",".join(alts), ".", ".", "DB", "GT:PL", "0/1:" + ",".join(map(str, range(n)))], [1 + k]) for k in range(30)]
    df = spark.createDataFrame(rows, "fields array<string>, drop array<int>")
    got = [x.f for x in df.select(alleles.without_alleles(F.col("fields"), F.col("drop"), {}, {"PL": "G"}, 5).alias("f")).collect()]
    for f, (fields, drop) in zip(got, rows):
        assert f[9].split(":")[1] == ",".join(str(k) for k, g in enumerate(_genotypes(31, 2)) if drop[0] not in g)


def test_work_is_dealt_whatever_the_files(spark):
    from strandloom.plans import catalogue

    assert catalogue.QUERIES["v11_remove_alleles"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4
