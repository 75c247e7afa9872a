"""The cap on mapping qualities against a walk over bases."""

import math
import random
import re

from pyspark.sql import functions as F

from strandloom.operators import realign


def _model(cigar, seq, qual, ref, threshold):
    x = y = bases = off = weight = clip = 0
    for n, op in ((int(a), b) for a, b in re.findall(r"(\d+)(\D)", cigar)):
        if op in "M=X":
            for k in range(min(n, len(ref) - x)):
                own, there = seq[y + k].upper(), ref[x + k].upper()
                if qual[y + k] >= 13 and "N" not in (own, there):
                    bases += 1
                    if own not in ("=", there):
                        off, weight = off + 1, weight + min(33, qual[y + k])
        if op in "M=XD" and x + n > len(ref):
            break
        if op == "S":
            clip += sum(qual[y : y + n])
        if op == "H":
            clip += 13 * n
        if op in "M=X":
            bases += n
        x, y = x + (n if op in "M=XDN" else 0), y + (n if op in "M=XIS" else 0)
    t = weight - 4.343 * (off * math.log(bases or 1) - math.lgamma(off + 1)) + clip / 5
    return -1 if t > threshold else int(math.sqrt((threshold - max(t, 0)) / threshold) * threshold + 0.499)


def test_cap_against_a_model(spark):
    r = random.Random(2)
    rows = []
    for k in range(300):
        cigar = "".join(f"{r.randrange(1, 9)}{op}" for op in r.choice(["M", "SM", "HMIM", "MDMS", "MNXH", "S=DMIMS"]))
        n = sum(int(a) for a, op in re.findall(r"(\d+)(\D)", cigar) if op in "MIS=X")
        span = sum(int(a) for a, op in re.findall(r"(\d+)(\D)", cigar) if op in "MDN=X")
        ref = "".join(r.choice("ACGTacgN") for _ in range(max(1, span - r.choice([0, 0, 1, 4]))))
        seq = "".join(r.choice("ACGTN=") if r.random() < 0.3 else (ref[i % len(ref)]) for i in range(n))
        rows.append((k, cigar, seq, [r.randrange(41) for _ in range(n)], ref))
    df = spark.createDataFrame(rows, "k int, cigar string, seq string, qual array<int>, ref string")
    for threshold in (40, 60):
        got = {x.k: x.cap for x in df.select("k", realign.mapping_quality_cap(F.col("cigar"), F.col("seq"), F.col("qual"), F.col("ref"), threshold).alias("cap")).collect()}
        assert got == {k: _model(*x, threshold) for k, *x in rows} and len(set(got.values())) > 5
    nothing = df.limit(1).select(*[realign.mapping_quality_cap(*[F.lit(None).cast(df.schema[c].dataType) if c == n else F.col(c) for c in ("cigar", "seq", "qual", "ref")]).alias(n) for n in ("cigar", "seq", "qual", "ref")])
    assert set(nothing.first()) == {None}
