"""BAM files written and read again."""

import random

import pytest

from strandloom.sources import alignments, bam_sink, blocks

HEADER = bam_sink.header_of([("c1", 400_000), ("c2", 400_000), ("e", 10)], command="test")
SCHEMA = alignments.SCHEMA


def some(n=2000):
    r, out = random.Random(4), []
    for k in range(n):
        a, d = r.randrange(1, 200), r.randrange(1, 500)
        seq = "".join(r.choices("ACGTN", k=a + 4))
        out.append((f"q{k:05d}", 0, r.choice(["c1", "c2"]), r.randrange(300_000), r.randrange(60), f"{a}M{d}D4=", "=", 5, -7, seq, "".join(chr(33 + x % 90) for x in range(a + 4)), {"HP": "1", "PS": str(k), "XX": "a b", "ML": "C,1,255"} if k % 3 else {}))
    return out + [("u", 4, "*", -1, 0, "*", "*", -1, 0, "*", "*", {}), ("long", 0, "c1", 7, 9, "150000M", "*", -1, 0, "ACGTT" * 30_000, "*", {})]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sink") / "out")
    bam_sink.written(spark.createDataFrame(some(), SCHEMA), at, HEADER, 4)
    return at


def rows(df):
    return sorted(str((*r[:-1], sorted(r[-1].items()))) for r in (tuple(x) for x in df.select(*[c.split()[0] for c in SCHEMA.split(", ")]).collect()))


def test_round_trip(spark, folder):
    import os

    want = sorted(str((*r[:-1], sorted(r[-1].items()))) for r in some())
    assert rows(alignments.scan_bam(spark, folder)) == rows(alignments.scan_bam(spark, folder, step=9_000)) == rows(alignments.read_bam(spark, folder + "/*.bam")) == want
    names = sorted(os.listdir(folder))
    assert names == [f"part-{k:05d}.bam{e}" for k in range(4) for e in ("", ".bai")]
    keys = [(("c1", "c2", "*").index(r.rname), r.pos) for n in names if n.endswith(".bam") for r in alignments.scan_bam(spark, f"{folder}/{n}").orderBy("voffset").collect()]
    assert keys == sorted(keys, key=lambda k: (k[0], k[1])) and len(keys) == len(want)
    text, contigs, _ = alignments.bam_header(alignments.inflated(open(f"{folder}/part-00000.bam", "rb").read()))
    assert text == HEADER and contigs == [("c1", 400_000), ("c2", 400_000), ("e", 10)]


@pytest.mark.parametrize("region", ["c1:1-100", "c1:150000-151000", "c2:1000-90000", "c2:299999", "e"])
def test_regions(spark, folder, region):
    name, begin, end = alignments.parsed_region(region)
    over = lambda r: r[2] == name and r[3] < end and r[3] + (sum(int(x) for x in __import__("re").findall(r"(\d+)[MD=]", r[5]))) > begin
    assert sorted(r.qname for r in alignments.scan_bam(spark, folder, region).collect()) == sorted(r[0] for r in some() if over(r))


def test_empty_and_failed(spark, folder, tmp_path):
    import os

    at = str(tmp_path / "none")
    bam_sink.written(spark.createDataFrame([], SCHEMA), at, HEADER)
    assert os.listdir(at) and alignments.scan_bam(spark, at).count() == 0
    at = str(tmp_path / "failed")
    bad = [(*r[:2], "absent", *r[3:]) if r[0] == "q00042" else r for r in some(200)]
    with pytest.raises(Exception, match="absent"):
        bam_sink.written(spark.createDataFrame(bad, SCHEMA), at, HEADER, 4)
    assert not os.path.isdir(at) or os.listdir(at) == []


def test_programs():
    one = bam_sink.with_program(HEADER, "strandloom", "again")
    assert one.splitlines()[-1] == "@PG\tID:strandloom.1\tPN:strandloom\tPP:strandloom\tCL:again"
    two = bam_sink.with_program("@HD\tVN:1\n@PG\tID:a\n@PG\tID:b\tPP:a\n@PG\tID:c\tPP:a\n", "x")
    assert two.splitlines()[-2:] == ["@PG\tID:x\tPN:x\tPP:b", "@PG\tID:x.1\tPN:x\tPP:c"]
    assert bam_sink.with_program("@HD\tVN:1\n", "x").splitlines()[-1] == "@PG\tID:x\tPN:x"


def test_bins():
    for a, z in ((0, 1), (16383, 16385), (0, 1 << 29), (5 << 20, (5 << 20) + 9)):
        assert bam_sink.smallest_bin(a, z) in blocks.region_bins(a, z)


def test_odd_letters_and_nulls(spark, tmp_path):
    """A letter whose upper case is two, nulls in every place, and tags with a null value or none; nothing shifts the fields behind it."""
    at = str(tmp_path / "odd")
    odd = [("a", 0, "c1", 5, 7, "3M", "*", -1, 0, "aßg", '!~"', {"XX": None, "PS": "-12", "BB": "s,-3,4"}), ("b", *[None] * 11), ("c", 16, "c2", None, 1, "1S2=1H", "=", 3, 2, "ac", None, {})]
    bam_sink.written(spark.createDataFrame(odd, SCHEMA), at, HEADER, 1)
    got = [tuple(r) for r in alignments.scan_bam(spark, at).orderBy("qname").drop("file", "voffset").collect()]
    assert got == [
        ("a", 0, "c1", 5, 7, "3M", "*", -1, 0, "ANG", '!~"', {"BB": "s,-3,4", "PS": "-12"}), ("b", 0, "*", -1, 0, "*", "*", -1, 0, "*", "*", {}), ("c", 16, "c2", -1, 1, "1S2=1H", "=", 3, 2, "AC", "*", {}),
    ]
    with pytest.raises(Exception, match="range"):
        bam_sink.written(spark.createDataFrame([(*odd[0][:10], "! !", {})], SCHEMA), at, HEADER, 1)


def test_batches_are_written_without_rows():
    """Rows made of batches took more than the coding of records."""
    from pyspark.sql.datasource import DataSourceArrowWriter

    assert issubclass(bam_sink._Writer, DataSourceArrowWriter)
