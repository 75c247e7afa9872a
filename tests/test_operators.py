"""Operators against models in plain Python and small cases worked out by hand."""

import gzip
import math
import random
import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandloom.functions import basemods, filters, stats, strings
from strandloom.operators import cigar, cnv, edges, overlap, phase, ranges, tag, variants
from strandloom.params import PhaseParams
from strandloom.plans import api
from strandloom.plans.bindings import view
from strandloom.sources import alignments, sequences, vcf

SF = "/root/testdata/sf0.001"


def test_islands_equal_whole_chromosomes(spark):
    o = view(spark, SF, "obs_gapped")
    t = edges.node_types(o)
    e = edges.decided(edges.edge_weights(o), t)
    n = phase.nodes(t, e, 10)
    got = {(r.chrom, r.pos): (r.block, r.hp) for r in phase.greedy(n, e).collect()}
    node, edge = n.toPandas(), e.where("decision <> 0").toPandas()
    assert node.groupby("chrom").island.nunique().min() > 1
    want = {}
    for c in node.chrom.unique():
        for r in phase.walk(node[node.chrom == c], edge[edge.chrom == c], 35).itertuples():
            want[(r.chrom, r.pos)] = (r.block, r.hp)
    assert got == want


def test_flipping_all_alleles_keeps_blocks(spark):
    o = view(spark, SF, "obs_gapped")
    blocks = lambda x: {tuple(r) for r in phase.block_summary(api.phase_observations(x)).collect()}
    assert blocks(o) == blocks(o.withColumn("allele", 1 - F.col("allele")))


def test_cnv_intervals():
    steep = [(100, 8, 0), (200, 0, 3), (300, 0, 6)]
    assert cnv.intervals_of(steep) == [(100, 300)]
    assert cnv.intervals_of([(100, 2, 0), (150, 1, 0), (400, 0, 5)]) == [(100, 400)]
    assert cnv.intervals_of([(100, 2, 0), (40_100, 1, 0), (40_200, 0, 9)]) == []
    assert cnv.intervals_of([]) == []


def _cnv_model(rows):
    """One row at a time with everything that is open in a dictionary."""
    found, now = [], None
    for pos, up, down in [*rows, (rows[-1][0] + 30_000, *rows[-1][1:])]:
        if now is None or (now["peak"] is None and up >= 5 and not down >= (now["n"] // 4 if now["n"] > 20 else 5)) or (now and now["peak"] is not None and up > now["peak"]):
            carried = now["n"] + up - down if now and now["peak"] is not None else None
            opens = now is not None or up >= 5 or up > down
            now = {"start": pos, "n": up - down if carried is None else carried, "peak": up if up >= 5 else None, "wait": pos + 30_000} if opens else None
            if carried is None:
                continue
            before = 0
        else:
            before = now["n"]
            now["n"] += up - down
        if now["peak"] is None:
            closed = down >= (before // 4 if before > 20 else 5)
        now["wait"] = pos + 30_000 if now["n"] > 30 else now["wait"]
        if now["peak"] is not None:
            p = now["peak"]
            closed = down >= (5 if p < 10 else p // 2) or (now["n"] <= (2 if p < 10 else p // 4 if p < 20 else 5) and pos <= now["wait"])
        if closed:
            found.append((now["start"], pos))
        if closed or now["n"] <= 0 or pos > now["wait"] or pos - now["start"] >= 200_000:
            now = None
    return found


def _histogram(seed):
    r = random.Random(seed)
    step, most, share, pos, rows = r.choice([500, 5_000, 60_000, 200_000]), r.choice([2, 4, 8, 16, 40]), r.choice([0.3, 0.5, 0.7]), 0, []
    for _ in range(r.randrange(1, 150)):
        pos += r.randrange(1, step)
        rows.append((pos, r.randrange(most) if r.random() < share else 0, r.randrange(most) if r.random() > share else 0))
    return rows


def test_copy_number_intervals_against_a_model(spark):
    for seed in range(1_000):
        assert cnv.intervals_of(_histogram(seed)) == _cnv_model(_histogram(seed))
    rows = [(c, *x) for c in range(200) for x in _histogram(c)]
    h = spark.createDataFrame(rows, "chrom long, pos long, front int, back int")
    got = sorted(map(tuple, cnv.cnv_intervals(h).collect()))
    assert got == [(c, *x) for c in range(200) for x in _cnv_model(_histogram(c))] and len(got) > 400
    assert cnv.parts(h).select("chrom", "stretch", "part").distinct().count() > 400
    assert cnv.cnv_intervals(h.where("false")).count() == 0


def _dropped(spark, rows, threshold):
    df = spark.createDataFrame(list(enumerate(rows)), "i int, spans array<struct<first:long,last:long>>")
    return [set(r.gone) for r in df.select("i", overlap.dropped(F.col("spans"), threshold).alias("gone")).orderBy("i").collect()]


def test_overlapping_alignments(spark):
    assert _dropped(spark, [[(10, 100)], [(10, 100), (50, 120)], [(10, 100), (20, 90)], [(10, 100), (200, 300)], []], 0.2) == [set(), {1}, {1}, set(), set()]
    assert _dropped(spark, [[(10, 100), (50, 400)]], 0.05) == [{0}]


def _drop_model(spans, threshold):
    """Recursion over positions covered, written down as sets of positions."""
    cover = [set(range(a, b + 1)) for a, b in spans]

    def settle(k, kept, end):
        if not kept or spans[k][0] > end:
            return [*kept, k], True
        if spans[k][1] < end:
            return kept, False
        s = kept[-1]
        if len(cover[s] & cover[k]) < threshold * len(cover[s] | cover[k]) or not cover[s] & cover[k]:
            return [*kept, k], True
        if len(cover[k]) <= len(cover[s]):
            return kept, False
        return settle(k, kept[:-1], spans[kept[-2]][1] if len(kept) > 1 else -1)

    kept = []
    for k in range(len(spans)):
        kept, _ = settle(k, kept, spans[k - 1][1] if k else -1)
    return set(range(len(spans))) - set(kept)


@pytest.mark.parametrize("threshold", [0.05, 0.25, 0.5])
def test_overlapping_alignments_against_a_model(spark, threshold):
    r = random.Random(5)
    rows = [[(a, a + r.randrange(60)) for a in (r.randrange(100) for _ in range(r.randrange(9)))] for _ in range(400)]
    assert _dropped(spark, rows, threshold) == [_drop_model(x, threshold) for x in rows]


def test_reads_without_overlapping_alignments(spark):
    rows = [(1, 7, read, p, 0) for read, p in ((1, 10), (1, 100), (2, 5))] + [(1, 8, 1, p, 0) for p in (50, 120)]
    obs = spark.createDataFrame(rows, "chrom long, aln_id long, read_id long, pos long, allele int")
    assert {(x.aln_id, x.pos) for x in overlap.without_overlaps(obs).collect()} == {(7, 10), (7, 100), (7, 5)}
    assert overlap.without_overlaps(obs.where("false")).count() == 0


def test_crowded_homopolymers(spark):
    rows = [(1, p, r) for p, r in ((1, 3), (3, 3), (4, 3), (6, 3), (20, 3), (21, 2), (22, 3))]
    got = variants.crowded_homopolymers(spark.createDataFrame(rows, "chrom long, pos long, run int")).collect()
    assert sorted(r.pos for r in got) == [3, 6, 22]


@pytest.mark.parametrize("seed", range(3))
def test_range_join_against_brute_force(spark, seed):
    r = random.Random(seed)
    iv = [(k % 2, k, s, s + r.randrange(50)) for k in range(60) for s in [r.randrange(300)]]
    pt = [(k % 2, r.randrange(350)) for k in range(80)]
    i, p = spark.createDataFrame(iv, "chrom long, iv long, s long, e long"), spark.createDataFrame(pt, "chrom long, pos long")
    got = sorted((x.iv, x.pos) for x in ranges.point_join(i, p, ["chrom"], "s", "e", "pos", 16).collect())
    assert got == sorted((k, q) for c, k, s, e in iv for d, q in pt if c == d and s <= q <= e)
    j = i.toDF("chrom", "iv2", "s2", "e2")
    got = sorted((x.iv, x.iv2) for x in ranges.overlap_join(i, j, ["chrom"], ("s", "e"), ("s2", "e2"), 16).collect())
    assert got == sorted((a[1], b[1]) for a in iv for b in iv if a[0] == b[0] and a[2] <= b[3] and b[2] <= a[3])


def test_cigar(spark):
    d = spark.createDataFrame([(0, "3S5M2I4M1D2M2H")], "pos long, cigar string")
    r = d.select(cigar.query_length(F.col("cigar")).alias("q"), cigar.ref_length(F.col("cigar")).alias("r")).first()
    assert (r.q, r.r) == (16, 12)
    b = cigar.blocks(d.withColumn("pos", F.lit(100)), []).orderBy("op_index").collect()
    assert [(x.op, x.ref_start, x.query_start) for x in b] == [("S", 100, 0), ("M", 100, 3), ("I", 105, 8), ("M", 105, 10), ("D", 109, 14), ("M", 110, 14), ("H", 112, 16)]


CASES = [("A", "G", "SNP", 1), ("A", ".", "REF", 0), ("A", "<DEL>", "OTHER", 0), ("A", "<*>", "REF", 0), ("A", "*", "OVERLAP", 0), ("A", "AT", "INS", 1), ("ACG", "A", "DEL", -2), ("AC", "GT", "MNP", 2), ("A", "A[2:3[", "BND", 0), ("AAT", "AT", "DEL", -1), ("ACA", "AGA", "SNP", 1), ("a", "A", "REF", 0)]


def test_variant_types(spark):
    d = spark.createDataFrame([c[:2] for c in CASES[:-1]], "r string, a string")
    got = [(x.t.type, x.t.n) for x in d.select(strings.variant_type(F.col("r"), F.col("a")).alias("t")).collect()]
    assert got == [c[2:] for c in CASES[:-1]]


def test_strings(spark):
    d = spark.createDataFrame([("AAACCCCCCCCCCCCG", 5), ("ACGT", 3), ("AAAA", 0)], "s string, p long")
    assert [r[0] for r in d.select(strings.run_length(F.col("s"), F.col("p"))).collect()] == [10, 1, 4]
    g = spark.createDataFrame([("0/1",), ("1/1",), ("0|0",), ("1/2",), ("0",), ("1",), ("./1",), (None,)], "g string")
    assert [r[0] for r in g.select(strings.genotype_class(F.col("g"))).collect()] == ["HET_RA", "HOM_AA", "HOM_RR", "HET_AA", "HAPL_R", "HAPL_A", "UNKN", "UNKN"]
    q = spark.createDataFrame([("chr1",), ("{a:b}:5-7",), ("x:1,000",), ("y:2-1,0",)], "t string").select(strings.region(F.col("t")).alias("r")).collect()
    assert [tuple(x.r) for x in q] == [("chr1", 1, None), ("a:b", 5, 7), ("x", 1000, None), ("y", 2, 10)]
    f = spark.range(4096).select(F.col("id"), strings.flag_of(strings.flag_names(F.col("id"))).alias("f"))
    assert f.where("id <> f").count() == 0


@pytest.mark.parametrize(("text", "want"), [
    ("1 || 0 && 0", False), ("!(x > 1)", True), ("x > 1", False), ("!x", True), ("[NM]", True), ("![XX]", True), ("n / 0 > 5", True), ("n % 0", False), ("!(n % 0)", True),
    ('s == "ab"', True), ('s == 1', False), ('s != 1', True), ('s =~ "^a[[:lower:]]"', True), ("length(s)", True), ("default(x, 0)", False), ("-(2 - 3) == 1", True), ("6 & 3 == 2", False), ("(6 & 3) == 2", True), ("2 + 3 * 2 == 8", True), ("~5 == -6", True), ("sqrt(-1)", False),
])
def test_filter_language(spark, text, want):
    d = spark.createDataFrame([(4.0, None, "ab", {"NM": "0"})], "n double, x double, s string, t map<string,string>")
    names = {c: F.col(c) for c in "nxs"}
    if text == "6 & 3 == 2":  # comparison binds less than bits
        want = True
    assert d.select(filters.predicate(text, names, {"s": "str"}, F.col("t"))).first()[0] is want


def test_filter_errors(spark):
    for text in ("1 +", "nope", "(1", 'sqrt("a" + 1)', "1 1"):
        with pytest.raises(filters.FilterError):
            filters.compiled(text, {})


def test_statistics(spark):
    assert stats.fisher(3, 1, 1, 3)[3] == pytest.approx(0.4857142857)
    assert stats.gamma_p(2, 1.5) == pytest.approx(1 - math.exp(-1.5) * 2.5)
    assert stats.beta_i(2, 3, 0.4) == pytest.approx(0.5248)
    d = spark.createDataFrame([(3, 1, 1, 3)], "a int, b int, c int, d int").select(stats.fisher_exact("a", "b", "c", "d").alias("f")).first().f
    assert d.two == pytest.approx(0.4857142857)


def test_base_modifications():
    got = list(basemods.decoded("AGCTCTCC", False, "C+m,1,0;", [10, 200]))
    assert got == [(4, "m", "C", 0, 10), (6, "m", "C", 0, 200)]
    back = list(basemods.decoded("GGAGAGCT", True, "C+m,1,0;", [10, 200]))
    assert back == [(3, "m", "C", 0, 10), (1, "m", "C", 0, 200)]
    assert list(basemods.decoded("CC", False, "C+mh,0;", [1, 2])) == [(0, "m", "C", 0, 1), (0, "h", "C", 0, 2)]
    assert list(basemods.decoded("AC", False, "N+76792?,1;", []))[0][:2] == (1, "76792")
    with pytest.raises(ValueError):
        list(basemods.decoded("C", False, "C+m,3;", []))


def _bam(records: list[tuple[str, int, str]]) -> bytes:
    body = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    for name, pos, seq in records:
        packed = bytes("=ACMGRSVTWYHKDBN".index(seq[k]) << 4 | ("=ACMGRSVTWYHKDBN".index(seq[k + 1]) if k + 1 < len(seq) else 0) for k in range(0, len(seq), 2))
        r = struct.pack("<iiBBHHHiiii", 0, pos, len(name) + 1, 60, 0, 1, 16, len(seq), -1, -1, 0) + name.encode() + b"\0" + struct.pack("<I", len(seq) << 4) + packed + bytes([30] * len(seq)) + b"NMi" + struct.pack("<i", 2) + b"RGZx\0" + b"MLBC" + struct.pack("<IBB", 2, 7, 8)
        body += struct.pack("<i", len(r)) + r
    return body


def test_bam(spark, tmp_path):
    data = _bam([("r1", 10, "ACGTA"), ("r2", 20, "GG")])
    (tmp_path / "a.bam").write_bytes(gzip.compress(data[:40]) + gzip.compress(data[40:]))
    rows = alignments.read_bam(spark, str(tmp_path)).orderBy("aln_id").collect()
    assert [(r.qname, r.pos, r.cigar, r.seq, r.qual, r.tags) for r in rows][0] == ("r1", 10, "5M", "ACGTA", "?????", {"NM": "2", "RG": "x", "ML": "C,7,8"})
    spark.dataSource.register(alignments.BamSource)
    assert spark.read.format("bam_records").load(str(tmp_path / "*.bam")).count() == 2


def test_sam_round_trip(spark, tmp_path):
    line = "q\t16\tchr1\t11\t60\t5M\t*\t0\t0\tACGTA\tIIIII\tHP:i:2\tRG:Z:x"
    (tmp_path / "a.sam").write_text("@HD\tVN:1.6\n" + line + "\n")
    r = alignments.read_sam(spark, str(tmp_path / "a.sam"))
    assert alignments.sam_lines(r).first().line == line
    j = r.select("aln_id", F.lit(1).alias("hp"), F.lit(7).alias("ps"), F.lit(40).alias("pq"))
    assert alignments.tagged(r, j).first().tags == {"HP": "1", "PS": "7", "PQ": "40", "RG": "x"}


VCF = """##fileformat=VCFv4.2
##contig=<ID=c1,length=100>
##FORMAT=<ID=GT,Number=1,Type=String,Description="x">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS
c1\t11\t.\tA\tG\t50\tPASS\t.\tGT:PS:DP\t0|1:4:9
c1\t21\t.\tC\tT\t50\tPASS\t.\tGT\t1/0
c1\t31\t.\tC\tCT\t3\tPASS\t.\tGT\t0/1
c1\t41\t.\tC\tT\t50\tPASS\tSVLEN=-30\tGT\t1/1"""


def test_vcf_rewrite(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)  # no newline at the end
    lines = vcf.read_lines(spark, str(tmp_path / "a.vcf"))
    rec = vcf.records(lines)
    kept, removed = vcf.snps_and_indels(rec, True, 10)
    assert sorted(r.pos for r in kept.collect()) == [10, 20] and [r.pos for r in removed.collect()] == [30]
    assert vcf.contigs(lines).first().length == 100
    result = spark.createDataFrame([("c1", 20, "1|0", 21)], "chrom string, pos long, gt string, ps long")
    out = [r.line for r in vcf.phased_lines(lines, result, "run", removed).orderBy("line_no", "part").collect()]
    assert out[3].startswith("##FORMAT=<ID=PS") and out[4].startswith("##commandline") and out[6].startswith("#CHROM")
    assert [x.split("\t")[8:] for x in out[7:]] == [["GT:DP:PS", "0/1:9:."], ["GT:PS", "1|0:21"], ["GT:PS", "0/1:."], ["GT:PS", "1/1:."]]
    assert out[9].split("\t")[6] == "INDEL_QUAL_FILTERED"
    with pytest.raises(ValueError):
        vcf.read_lines(spark, "a.bcf")


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">c1 x\nACGT\nacgt\n>c2\nGG\n")
    t = sequences.read_fasta(spark, str(tmp_path / "a.fa"))
    assert {r.chrom: r.length for r in sequences.contig_lengths(t).collect()} == {"c1": 8, "c2": 2}
    assert sequences.fetch(t, "c1", 2, 6).first().seq == "GTAC"
    p = spark.createDataFrame([("c1", 4)], "chrom string, pos long")
    r = sequences.around(p, t, 2).first()
    assert (r.context, r.offset) == ("GTACG", 2)
    (tmp_path / "a.fq").write_text("@r1/1 1:Y:0:AC\nAC\n+\nII\n@r2\nGT\n+\n!!\n")
    q = {r.name: r for r in sequences.read_fastq(spark, str(tmp_path / "a.fq")).collect()}
    assert q["r1"].read_no == 1 and q["r2"].seq == "GT" and q["r2"].qual == "!!"
    (tmp_path / "a.bed").write_text("c1\t5\t9\n")
    assert tuple(sequences.read_intervals(spark, str(tmp_path / "a.bed"), "bed").first()) == ("c1", 5, 8)


def _genome(spark):
    """Four SNPs, reads of two haplotypes."""
    r = random.Random(1)
    ref = "".join(r.choice("ACGT") for _ in range(400))
    sites = [50, 120, 200, 280, 350]
    alt = {p: "ACGT"[("ACGT".index(ref[p]) + 1) % 4] for p in sites}
    hap2 = "".join(alt.get(k, b) for k, b in enumerate(ref))
    flip = {120: 1, 280: 1}
    h = ["".join(alt[k] if k in alt and flip.get(k, 0) == 0 else b for k, b in enumerate(ref)), "".join(alt[k] if k in alt and flip.get(k, 0) == 1 else b for k, b in enumerate(ref))]
    del hap2
    rows = []
    for k in range(24):
        s = r.randrange(0, 60)
        seq = h[k % 2][s : s + 330]
        rows.append((1, k, k, f"q{k}", s, 60, 0, f"{len(seq)}M", seq, "I" * len(seq)))
    reads = spark.createDataFrame(rows, "chrom long, aln_id long, read_id long, qname string, pos long, mapq int, flag int, cigar string, seq string, qual string")
    snps = spark.createDataFrame([(1, p, ref[p], alt[p]) for p in sites], "chrom long, pos long, ref string, alt string")
    return reads, snps, sites, flip


def test_phase_and_haplotag_end_to_end(spark):
    reads, snps, sites, flip = _genome(spark)
    got = {r.pos: (r.gt, r.ps) for r in api.phase_reads(reads, snps, params=PhaseParams(ont=False)).collect()}
    assert set(got) == set(sites[:-1])  # the last variant of a chromosome is never placed
    assert len({ps for _, ps in got.values()}) == 1
    assert {p: got[p][0] == got[50][0] for p in got} == {p: not flip.get(p, 0) for p in got}
    phased = snps.join(spark.createDataFrame([(p, 1 if g == "0|1" else 2, ps) for p, (g, ps) in got.items()], "pos long, hp int, ps long"), "pos")
    tags = {r.aln_id: r for r in api.haplotag(reads, phased).collect()}
    assert {tags[k].hp for k in range(0, 24, 2)} != {tags[k].hp for k in range(1, 24, 2)} and all(t.hp in (1, 2) and t.pq == 40 for t in tags.values())


def test_modcall_end_to_end(spark):
    reads, snps, _, _ = _genome(spark)
    calls = spark.createDataFrame([(k, f"q{k}", 0, q, 255 if k % 2 else 0) for k in range(24) for q in range(100, 240, 20)], "aln_id long, read_name string, strand int, qpos long, prob int")
    # all reads start at one place, so that calls fall on the same sites
    flat = reads.withColumn("pos", F.lit(10).cast("long"))
    sites = api.modcall(flat, calls)
    rows = sites.collect()
    assert {r.pos for r in rows} == {q + 10 for q in range(100, 240, 20)} and all(r.gt == "0/1" and r.depth == 24 for r in rows)


def test_phasing_quality(spark):
    d = spark.createDataFrame([(0, 0), (5, 0), (9, 1), (3, 3)], "a long, b long")
    assert [r[0] for r in d.select(tag.phasing_quality(F.col("a"), F.col("b"))).collect()] == [0, 40, 10, 3]


def test_parameters():
    with pytest.raises(ValueError):
        PhaseParams(edge_threshold=2)


def test_streams(spark, tmp_path):
    from strandloom.streaming import incremental

    o = view(spark, SF, "obs").select(F.col("chrom").cast("long"), F.col("read_id").cast("long"), F.col("pos").cast("long"), F.col("allele").cast("long"), "qual", "vtype")
    o.repartition(3).write.parquet(str(tmp_path / "in"))
    q = incremental.allele_depths(incremental.observations(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("depths").start()
    q.processAllAvailable()
    q.stop()
    want = incremental.allele_depths(o)
    assert spark.table("depths").exceptAll(want).count() == 0 and spark.table("depths").count() == want.count()


def test_empty_inputs(spark):
    o = view(spark, SF, "obs").where("false")
    assert api.phase_observations(o).count() == 0
    assert isinstance(edges.edge_weights(o).toPandas(), pd.DataFrame)
