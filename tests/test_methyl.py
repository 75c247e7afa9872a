"""Connected modification sites against a model in plain Python."""

import random

import pytest

from strandloom.operators import methyl

SITE, SNP = 2, 0


def _model(kinds, depth, pairs, adjacent, confidence, rounds, with_snps):
    """Sites of one contig. kinds: {pos: kind}; pairs: {(p, q): (same, flipped)}."""

    def firm(p, q):
        n = sum(pairs.get((p, q), (0, 0)))
        return n > 6 and n > (depth[p] + depth[q]) / 4

    def sure(p, q):
        return max(pairs[p, q]) >= confidence * sum(pairs[p, q])

    def way(p, partners):
        """The partners in order up to the first without enough reads."""
        for q in partners:
            if not firm(p, q):
                return
            yield q

    line = sorted(kinds)
    first = {p for p, _ in pairs}
    after = lambda p, of: [q for q in sorted(of) if q > p]
    strong, met = set(line), set()
    if with_snps:
        strong = set()
        for p in first:
            reached = list(way(p, after(p, line)[: adjacent if kinds[p] == SITE else None]))
            others = [q for q in reached if kinds[q] != kinds[p]]
            if kinds[p] == SITE and others:
                met.add(p)
            elif kinds[p] == SNP:
                met.update(others)
            if any(sure(p, q) for q in others):
                strong.add(p if kinds[p] == SITE else after(p, line)[0])
    else:
        strong = {p for p in line if kinds[p] == SITE}

    added = {x for p in strong & first for q in way(p, after(p, strong)[:adjacent]) if sure(p, q) for x in (p, q)}
    passed = added | ({p for p in first if kinds[p] == SNP} if with_snps else set())
    weak = added | {p for p in first if kinds[p] == SITE and p not in met}
    for _ in range(rounds if with_snps else 0):
        new, idle = set(), set()
        for p in weak & first:
            partners = [q for q in after(p, weak)[:adjacent] if p in added or q in added]
            idle |= set() if partners else {p}
            new |= {x for q in way(p, partners) if sure(p, q) for x in (p, q)}
        added = new - passed
        weak, passed = added | idle, passed | added

    def holds(p, q):
        return sum(pairs.get((p, q), (0, 0))) >= 6 and sure(p, q)

    kept, order = [], sorted(passed)
    for k, p in enumerate(order):
        before, behind = order[k - 1] if k else None, order[k + 1] if k + 1 < len(order) else None
        if kinds[p] != SNP and (before is None or (before in first if behind is None else holds(before, p) and holds(p, behind))):
            kept.append(p)
    return kept


def _contigs(seed, n):
    """Chains of pairs between near nodes, many of them well supported."""
    r = random.Random(seed)
    for c in range(n):
        pos = sorted(r.sample(range(200), r.randrange(1, 35)))
        share, reach, full, agree = r.choice([0.5, 0.7, 0.9]), r.choice([3, 6, 10]), r.choice([0.6, 0.9, 0.97]), r.choice([0.5, 0.8, 0.95])
        kinds = {p: SITE if r.random() < share else SNP for p in pos}
        depth = {p: r.choice([4, 8, 12, 30]) for p in pos}
        pairs = {}
        for i, p in enumerate(pos):
            for q in pos[i + 1 : i + 1 + reach]:
                if (kinds[p] == SITE or kinds[q] == SITE) and r.random() < 0.95:
                    total = r.randrange(8, 30) if r.random() < full else r.randrange(1, 9)
                    same = total if r.random() < agree else r.randrange(total + 1)
                    pairs[p, q] = (same, total - same)
        yield c, kinds, depth, pairs


@pytest.mark.parametrize(("adjacent", "confidence", "rounds", "with_snps"), [(20, 0.9, 2, True), (3, 0.75, 3, True), (4, 0.9, 2, False)])
def test_connected_sites_against_a_model(spark, adjacent, confidence, rounds, with_snps):
    contigs = list(_contigs(adjacent, 60))
    node = spark.createDataFrame([(c, p, k[p], d[p]) for c, k, d, _ in contigs for p in k], "chrom long, pos long, vtype int, n_reads long")
    pairs = spark.createDataFrame([(c, p, q, *v) for c, _, _, x in contigs for (p, q), v in x.items()], "chrom long, p1 long, p2 long, same long, flipped long")
    got = sorted(map(tuple, methyl.connected(node, pairs, adjacent, confidence, rounds, with_snps).collect()))
    want = [(c, p) for c, k, d, x in contigs for p in _model(k, d, x, adjacent, confidence, rounds, with_snps)]
    assert got == want and len(want) > 50


def test_connected_sites_without_rows(spark):
    node = spark.createDataFrame([], "chrom long, pos long, vtype int, n_reads long")
    pairs = spark.createDataFrame([], "chrom long, p1 long, p2 long, same long, flipped long")
    assert methyl.connected(node, pairs).collect() == []


def test_reads_are_counted_without_tables_of_them(spark):
    """Tables of (position, read) pairs were what a task needed most memory for."""
    from pyspark.sql import functions as F

    from strandloom.operators import methyl
    from strandloom.plans.bindings import view

    o = view(spark, "/root/testdata/sf0.001", "obs_dense").withColumn("read_id", F.when(F.col("read_id") % 11 > 0, F.col("read_id") % 300))
    node, _ = methyl.graph(o.unionByName(o))
    assert "distinct" not in node._jdf.queryExecution().optimizedPlan().toString()
    want = {(r.chrom, r.pos): r.n for r in o.groupBy("chrom", "pos").agg(F.count_distinct("read_id").alias("n")).collect()}
    assert {(r.chrom, r.pos): r.n_reads for r in node.collect()} == want
