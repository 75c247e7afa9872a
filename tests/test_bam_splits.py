"""Split, pruned reading of BAM files against the reader of whole files; files and indexes are made here."""

import random
import struct
import zlib

import pytest

from strandloom.sources import alignments, blocks

CONTIGS = [("c1", 500_000), ("c2", 300_000), ("c3", 1_000)]
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def block(data):
    d = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = d.compress(data) + d.flush()
    return struct.pack("<4BI2BH2sHH", 31, 139, 8, 4, 0, 0, 255, 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(ref, pos, name, seq, cigar, flag=0):
    ops = b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(op)) for n, op in cigar)
    bases = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0]
    packed = bytes(bases[k] << 4 | bases[k + 1] for k in range(0, len(seq), 2))
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 30, 0, len(cigar), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + ops + packed + bytes(k % 40 for k in range(len(seq)))
    body += b"NMi" + struct.pack("<i", pos) + b"RGZ" + b"g" * (pos % 50) + b"\0"
    return struct.pack("<i", len(body)) + body


def made(seed, n, longest, block_bytes):
    """(file, index, region query by brute force)."""
    r = random.Random(seed)
    rows = sorted((r.choice([0, 0, 1]), r.randrange(0, 250_000), f"q{k}") for k in range(n))
    recs, spans = [], []
    for ref, pos, name in rows:
        length = r.randrange(1, longest)
        gap = r.randrange(1, 400)
        cigar = [(length, "M"), (gap, "D"), (3, "=")]
        recs.append(record(ref, pos, name, "".join(r.choices("ACGTN", k=length + 3)), cigar))
        spans.append((ref, pos, pos + length + gap + 3, name))
    recs += [record(-1, -1, f"u{k}", "ACG", [], 4) for k in range(20)]
    head = b"BAM\1" + struct.pack("<i", 9) + b"@HD\tVN:1\n" + struct.pack("<i", len(CONTIGS)) + b"".join(struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", k) for c, k in CONTIGS)
    data = head + b"".join(recs)
    file, starts, at = b"", [], 0
    while at < len(data):
        size = r.randrange(1, block_bytes)
        starts.append((at, len(file)))
        file += block(data[at : at + size])
        at += size
    file += END
    starts.append((len(data), len(file) - len(END)))
    places = [x for x, _ in starts]

    def offset(x):
        import bisect

        k = bisect.bisect_right(places, x) - 1
        return starts[k][1] << 16 | x - starts[k][0]

    bins = [{} for _ in CONTIGS]
    linear = [{} for _ in CONTIGS]
    at = len(head)
    for rec, span in zip(recs, spans):
        ref, a, z, _ = span
        smallest = max((b for b in blocks.region_bins(a, z)), default=0)
        for first, bits in ((4681, 14), (585, 17), (73, 20), (9, 23), (1, 26), (0, 29)):
            if a >> bits == (z - 1) >> bits:
                smallest = first + (a >> bits)
                break
        bins[ref].setdefault(smallest, []).append((offset(at), offset(at + len(rec))))
        for w in range(a >> 14, ((z - 1) >> 14) + 1):
            linear[ref].setdefault(w, offset(at))
        at += len(rec)
    index = b"BAI\1" + struct.pack("<i", len(CONTIGS))
    for own, windows in zip(bins, linear):
        index += struct.pack("<i", len(own))
        for b, c in own.items():
            index += struct.pack("<Ii", b, len(c)) + b"".join(struct.pack("<QQ", *x) for x in c)
        n = max(windows, default=-1) + 1
        index += struct.pack("<i", n) + b"".join(struct.pack("<Q", windows.get(w, 0)) for w in range(n))
    return file, index, spans


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("bam")
    for name, args in {"short": (1, 3000, 150, 900), "long": (2, 60, 20_000, 4_000), "tiny": (3, 50, 30, 40), "big": (4, 4000, 300, 60_000)}.items():
        file, index, spans = made(*args)
        (at / f"{name}.bam").write_bytes(file)
        (at / f"{name}.bam.bai").write_bytes(index)
    return at


def rows(df):
    return sorted(map(str, df.select(*[c.split()[0] for c in alignments.SCHEMA.split(", ")]).collect()))


@pytest.mark.parametrize("name,step", [("short", 20_000), ("long", 60_000), ("long", 15_000), ("tiny", 300), ("big", 40_000), ("big", 0)])
def test_splits(spark, folder, name, step):
    path = str(folder / f"{name}.bam")
    got = alignments.scan_bam(spark, path, step=step)
    parts = spark.read.format("bam_records").option("step", step).option("report", "true").load(path).collect()
    assert (len(parts) > 3) == (step > 0)
    want = rows(alignments.read_bam(spark, path))
    assert rows(got) == want and sum(p.records for p in parts) == len(want)
    places = [r.voffset for r in got.select("voffset").collect()]
    assert len(set(places)) == len(places)


@pytest.mark.parametrize("name", ["short", "long", "big"])
@pytest.mark.parametrize("region", ["c1:100,000-101,000", "c1:1-20", "c2:249000", "c3", "absent"])
def test_regions(spark, folder, name, region):
    path = str(folder / f"{name}.bam")
    contig, begin, end = alignments.parsed_region(region)
    spans = made(*{"short": (1, 3000, 150, 900), "long": (2, 60, 20_000, 4_000), "big": (4, 4000, 300, 60_000)}[name])[2]
    want = sorted(n for ref, a, z, n in spans if CONTIGS[ref][0] == contig and a < end and z > begin)
    for step in (20_000, alignments.STEP):
        assert sorted(r.qname for r in alignments.scan_bam(spark, path, region, step).collect()) == want
    read = spark.read.format("bam_records").option("region", region).option("report", "true").load(path).agg({"bytes": "sum"}).first()[0] or 0
    if name == "big" and "-" in region:
        assert read < (folder / "big.bam").stat().st_size * 0.75
    if not want and contig != "c1" and contig != "c2":
        assert read == 0


def test_regions_read_few_bytes(folder):
    """The blocks planned for a region of a file of many blocks."""
    file, index, spans = made(5, 6000, 300, 3000)
    picked = blocks.chunks(index, 0, 100_000, 101_000, gap=0)
    assert sum((z >> 16) - (a >> 16) for a, z in picked) < 0.1 * len(file)
    reach = [(a, z) for a, z in picked]
    assert all(a < z for a, z in reach) and all(x[1] <= y[0] for x, y in zip(reach, reach[1:]))


def test_filters_are_pushed(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = alignments.scan_bam(spark, str(folder)).where("rname = 'c1' AND pos >= 100000 AND pos < 120000")
        want = sorted((n, a) for args in ((1, 3000, 150, 900), (2, 60, 20_000, 4_000), (3, 50, 30, 40), (4, 4000, 300, 60_000)) for ref, a, _, n in made(*args)[2] if ref == 0 and 100_000 <= a < 120_000)
        assert sorted((r.qname, r.pos) for r in got.collect()) == want
        assert alignments.scan_bam(spark, str(folder)).where("rname = '*'").count() == 80
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_filters_narrow_the_plan(folder):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    reader = alignments._PushedReader({"path": str(folder / "short.bam"), "step": "2000"})
    every = reader.partitions()
    list(reader.pushFilters([EqualTo(("rname",), "c1"), GreaterThanOrEqual(("pos",), 100_000), LessThan(("pos",), 101_000)]))
    some = reader.partitions()
    size = lambda ps: sum((p.split.stop >> 16) - p.split.after for p in ps)
    assert 0 < size(some) < 0.3 * size(every)


def test_damaged_and_odd_files(spark, folder, tmp_path):
    data = (folder / "short.bam").read_bytes()
    (tmp_path / "cut.bam").write_bytes(data[:-5000])
    with pytest.raises(Exception, match="damaged block|ends within|no block"):
        alignments.scan_bam(spark, str(tmp_path / "cut.bam")).count()
    (tmp_path / "none.bam").write_bytes(made(1, 0, 10, 50)[0])
    assert alignments.scan_bam(spark, str(tmp_path / "none.bam")).count() == 20
    with pytest.raises(Exception, match="absent.bam"):
        alignments.scan_bam(spark, str(tmp_path / "absent.bam")).count()


@pytest.mark.parametrize("args", [(1, 300, 150, 900), (2, 30, 9_000, 4_000), (3, 50, 30, 40)])
def test_every_step(args):
    import io

    file = made(*args)[0]
    lengths = [n for _, n in CONTIGS]
    head = blocks.Content(blocks.Bytes(lambda: io.BytesIO(file), 0, len(file), len(file)))
    while head.more():
        pass
    first = head.offset(alignments.bam_header(head.data)[2])
    want = list(blocks.records(lambda: io.BytesIO(file), len(file), blocks.splits(len(file), first, len(file) + 1)[0], lengths))
    for step in (50, 333, 1_000, 4_096, 20_000):
        got = [x for s in blocks.splits(len(file), first, step) for x in blocks.records(lambda: io.BytesIO(file), len(file), s, lengths)]
        assert got == want


def test_a_wrong_start_is_noticed():
    """A record whose tag holds what looks like records makes the split on the left fail, never the rows differ."""
    fake = record(0, 5, "fake", "ACGT", [(4, "M")]) * 40
    body = record(0, 1, "a", "ACGT", [(4, "M")])
    size = struct.unpack("<i", body[:4])[0]
    long = struct.pack("<i", size + len(fake) + 8) + body[4:] + b"XXBC" + struct.pack("<I", len(fake)) + fake
    data = body + long + body
    file = b"".join(block(data[k : k + 150]) for k in range(0, len(data), 150)) + END

    import io

    parts = blocks.splits(len(file), 0, 300)
    with pytest.raises(ValueError, match="told apart"):
        for s in parts:
            list(blocks.records(lambda: io.BytesIO(file), len(file), s, [500]))
    assert len(list(blocks.records(lambda: io.BytesIO(file), len(file), blocks.splits(len(file), 0, len(file) + 1)[0], [500]))) == 3
