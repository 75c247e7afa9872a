"""Pileups of typed alignments, overlapping mates and likelihoods against plain models."""

import collections
import math
import random
import re

import pytest

from strandloom.operators import likelihood, pileup

READS = {
    "pads": (
        [(2, "10M", "AGCTTAGCAG"), (2, "5M4I5M", "AGCTTGGCCAGCAG"), (2, "5M2I2P5M", "AGCTTGGAGCAG"), (2, "5M1P2I1P5M", "AGCTTGCAGCAG"), (2, "5M2P2I5M", "AGCTTCCAGCAG")],
        {2: "^!A^!A^!A^!A^!A", 5: "TTTTT", 6: "TT+4(GGCC)T+4(GG**)T+4(*GC*)T+4(**CC)", 7: "AAAAA", 11: "G$G$G$G$G$"},
    ),
    "inserted": ([(2, "11M", "AGCTTAGCAGG"), (2, "4M3I7M", "AGCTCCCTAGCAGG"), (2, "2I11M2I", "A=AGCTTAGCAGG=A")], {2: "^!A^!A^!A", 5: "TT+3(CCC)T", 12: "G$G$G+2(=A)$"}),
    "deleted": (
        [(2, "7M2D2I3M", "AGCTTAGTTGGC"), (2, "7M2D2I", "AGCTTAGTT"), (2, "7M2D1P1I", "AGCTTAGT"), (2, "2D2I9M", "AACTTAGCAGG"), (2, "2D1P1I9M", "ACTTAGCAGG")],
        {2: "^!A^!A^!A^!*^!*", 3: "GGG*+2(AA)*+2(*A)", 8: "G-2()G-2()G-2()GG", 9: "***CC", 10: "*+2(TT)*+2(TT)$*+2(*T)$AA", 11: "GGG", 13: "C$"},
    ),
    "mixed": (
        [(1, "5M6I5M", "AACCGGTTAACCGGTT"), (1, "4M1D2P2I2P1D4M", "AACCTAGGTT"), (1, "2M3D6I3D2M", "AAGTTAACTT"), (1, "4M2D4M", "AACCGGTT"), (1, "5D2P2I2P5D", "TA"), (5, "1M2P2I2P", "GTA")],
        {1: "^!A^!A^!A^!A^!*", 2: "AAA-3()A*", 4: "CC-1()*C-2()*", 5: "G+6(GTTAAC)*+6(**TA**)-1()*+6(GTTAAC)-3()**+6(**TA**)-5()^!G+6(**TA**)$", 10: "T$T$T$T$*$"},
    ),
    "skipped": ([(1, "4M2I5N2I4M", "TAGCAATTAGGT"), (1, "2S1M3N1M1H", "NNAC")], {1: "^!T^!A", 4: "C+2(AA)>", 5: ">C$", 9: ">+2(TT)", 10: "A"}),
}
SCHEMA = "chrom string, file int, aln_id long, pos long, mapq int, flag int, cigar string, seq string"


@pytest.mark.parametrize("name", READS)
@pytest.mark.parametrize("window", [pileup.WINDOW, 3])
def test_typed_alignments(spark, name, window):
    reads, want = READS[name]
    rows = [("z", 0, k, pos - 1, 0, 0, text, seq) for k, (pos, text, seq) in enumerate(reads)]
    got = {r.pos + 1: r.texts[0] for r in pileup.columns(spark.createDataFrame(rows, SCHEMA), 1, window=window).collect()}
    assert {p: got.get(p) for p in want} == want


def plain(rows, files):
    """A walk over each read, base by base."""
    out = collections.defaultdict(lambda: [[] for _ in range(files)])
    for chrom, file, k, pos, mapq, flag, text, seq in sorted(rows, key=lambda r: r[2]):
        ops = [(int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", text or "")] if not flag & 4 else []
        cells, q, p, held = [], 0, pos, ""
        for n, op in ops:
            if op in "M=XDN":
                if cells:
                    cells[-1][2] += ("+%d(%s)" % (len(held), held) if held.strip("*") else "") + ("-%d()" % n if op == "D" and n else "")
                held = ""
                for i in range(n):
                    cells.append([p + i, "*" if op == "D" else ">" if op == "N" else "N" if seq in (None, "*") else seq[q + i], ""])
                p += n
            if op == "I":
                held += "N" * n if seq in (None, "*") else seq[q : q + n]
            if op == "P":
                held += "*" * n
            q += n if op in "M=XIS" else 0
        if cells:
            cells[-1][2] += "+%d(%s)" % (len(held), held) if held.strip("*") else ""
        for i, (p, base, after) in enumerate(cells):
            out[chrom, p][file].append(("^" + chr(33 + min(93, mapq or 0)) if i == 0 else "") + base + after + ("$" if i == len(cells) - 1 else ""))
    return {k: ([len(x) for x in v], ["".join(x) for x in v]) for k, v in out.items()}


def test_files_against_a_walk(spark):
    r = random.Random(3)
    rows = [("a", 0, 900, 5, 1, 0, None, None), ("a", 1, 901, 5, None, 4, "5M", "ACGTA"), ("b", 2, 902, 7, 200, 0, "3M2I", None), ("b", 0, 903, 7, 1, 16, "2S4P", "AC"), ("b", 0, 903, 7, 1, 16, "3M0D2M", "ACGTA")]
    for k in range(150):
        ops = [(r.randrange(1, 9), r.choice("MMM=XIDNP")) for _ in range(r.randrange(1, 9))]
        seq = "".join(r.choices("ACGT", k=sum(n for n, op in ops if op in "M=XI") + 3))
        rows.append((r.choice("ab"), r.randrange(3), k, r.randrange(60), r.randrange(60), r.choice([0, 16, 99]), "3S" + "".join(f"{n}{op}" for n, op in ops), seq))
    for window in (7, 4096):
        df = spark.createDataFrame([(*x, 1, "x") for x in rows], SCHEMA + ", depths int, window string")
        got = {(x.chrom, x.pos): (x.depths, x.texts) for x in pileup.columns(df, 3, window=window).collect()}
        assert got == plain(rows, 3)
    assert pileup.columns(df.where("false"), 3).count() == 0


def aligned(pos, text):
    out, q = {}, 0
    for n, op in re.findall(r"(\d+)([MIDNSHP=X])", text):
        for _ in range(int(n)):
            if op in "M=X":
                out[pos] = q
            pos += op in "M=XDN"
            q += op in "M=XIS"
    return out


def test_mates_against_a_walk(spark):
    import hashlib

    r = random.Random(5)
    rows = []
    for k in range(120):
        for j in range(2):
            ops = [(r.randrange(1, 12), op) for op in r.choice(["M", "MDM", "MIM", "SMDMIM", "=X", "MNM"])]
            n = sum(x for x, op in ops if op in "M=XIS")
            rows.append((k // 100, f"n{k}", 2 * k + j, r.choice([99, 147]) if k % 10 else 65, r.randrange(12), "".join(f"{x}{op}" for x, op in ops), "".join(r.choices("AC", k=n)), [r.randrange(3) if k % 3 else r.randrange(150) for _ in range(n)]))
    rows += [(0, "single", 500, 99, 3, "4M", "ACGT", [1, 2, 3, 4]), (0, "three", 501, 99, 3, "4M", "ACGT", [1, 2, 3, 4]), (0, "three", 502, 99, 3, "4M", "ACGT", [1, 2, 3, 4]), (0, "three", 503, 147, 3, "4M", "ACGT", [1, 2, 3, 4]),
             (0, "bare", 504, 99, 3, "4M", "*", []), (0, "bare", 505, 147, 3, "4M", "ACGT", [1, 2, 3, 4]), (0, None, 506, 99, 3, "4M", None, None)]
    want = {x[2]: list(x[7]) if x[7] is not None else None for x in rows}
    by = collections.defaultdict(list)
    for x in rows:
        if x[3] & 0x90F == 3 and x[7]:
            by[x[0], x[1]].append(x)
    for (_, name), pair in by.items():
        if len(pair) != 2:
            continue
        a, b = sorted(pair, key=lambda x: (x[4], x[2]))
        first = hashlib.md5(name.encode()).hexdigest()[0] < "8"
        pa, pb = aligned(a[4], a[5]), aligned(b[4], b[5])
        for p in pa.keys() & pb.keys():
            x, y = a[7][pa[p]], b[7][pb[p]]
            same = a[6][pa[p]] == b[6][pb[p]]
            kept = min(200, x + y) if same else int(0.8 * max(x, y))
            won = first if same or x == y else x > y
            want[a[2]][pa[p]], want[b[2]][pb[p]] = (kept, 0) if won else (0, kept)
    df = spark.createDataFrame([(*x, 7) for x in rows], "chrom int, qname string, aln_id long, flag int, pos long, cigar string, seq string, qual array<int>, _n int")
    got = pileup.overlaps_resolved(df, []).collect()
    assert len(got) == len(rows) and {x.aln_id: x.qual for x in got} == want
    assert pileup.overlaps_resolved(df.where("false"), []).count() == 0


def test_mates_meet_by_one_shuffle_and_other_columns_stay(spark):
    """The reads were computed four times and joined three times; a read of a name without mates leaves its row, whatever its columns are called."""
    rows = [(0, "n", 1, 99, 0, "4M", "ACGT", [1, 2, 3, 4], 5, None, "x"), (0, "n", 2, 147, 2, "4M", "GTAC", [9, 2, 3, 4], 6, "b", None), (None, "n", 3, 99, 0, "4M", "ACGT", [1, 2, 3, 4], 7, "c", "y"), (0, "m", 4, 4, None, None, "AC", None, 8, "d", "z")]
    df = spark.createDataFrame(rows, "chrom int, qname string, aln_id long, flag int, pos long, cigar string, seq string, qual array<int>, n int, before string, _other string")
    out = pileup.overlaps_resolved(df, [])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 0 and plan.count("LogicalRDD") == 1
    got = sorted(tuple(r) for r in out.collect() if r.chrom == 0)
    assert [(r[2], *r[8:]) for r in sorted(got, key=lambda r: r[2])] == [(1, 5, None, "x"), (2, 6, "b", None), (4, 8, "d", "z")]
    assert {r.aln_id: r.qual for r in out.collect() if r.aln_id != 4}[3] == [1, 2, 3, 4]
    assert sorted(q for r in got if r[2] < 3 for q in r[7]) == sorted([1, 2, 3, 4, 0, 0, 12, 6])


def test_likelihoods_against_a_walk(spark):
    r = random.Random(9)
    rows = [(c, r.choice("ACG") if c else "A", r.randrange(70), r.randrange(2)) for c in range(6) for _ in range([0, 3, 40, 120, 1, 255][c])] + [(7, "C", None, 0)]
    want = {}
    for c in {x[0] for x in rows}:
        own = sorted(((min(63, max(4, q or 0)), s, a) for k, a, q, s in rows if k == c), reverse=True)
        n, seen, strand, e = len(own), collections.Counter(), collections.Counter(), collections.Counter()
        for q, s, a in own:
            p = 10 ** (-q / 10)
            tail = lambda k: math.fsum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k, n + 1))  # noqa: B023,E731
            k = seen[a]
            e[a] += (0.83 ** strand[a, s] * 0.97 + 0.03) * -10 * math.log10(tail(k + 1) / tail(k))
            seen[a] += 1
            strand[a, s] += 1
        for i, x in enumerate("ACG"):
            for y in "ACG"[i:]:
                v = sum(e[z] for z in "ACG" if z not in (x, y))
                if x != y:
                    v -= 4.343 * (math.log(math.comb(seen[x] + seen[y], seen[x])) - math.log(2) * (seen[x] + seen[y]))
                want[c, x, y] = max(0.0, v)
    df = spark.createDataFrame([(*x, 1) for x in rows], "c int, allele string, qual int, strand int, n int")
    got = {(x.c, x.first, x.second): x.phred for x in likelihood.genotypes(likelihood.allele_sums(df, ["c"]), ["c"], ["A", "C", "G"]).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-6), k
    deep = spark.range(2000).selectExpr("1 AS c", "if(id % 2 = 0, 'A', 'C') AS allele", "30 AS qual", "cast(id % 4 < 2 AS int) AS strand")
    sums = {x.allele: x for x in likelihood.allele_sums(deep, ["c"]).collect()}
    assert sums["A"].n == sums["C"].n == 1000 and 0 < sums["A"].error < math.inf
    assert likelihood.allele_sums(deep.where("false"), ["c"]).count() == 0
