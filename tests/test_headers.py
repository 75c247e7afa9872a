"""Union of headers and numbers of names, on small headers worked out by hand."""

from strandloom.operators import headers

A = ["##fileformat=VCFv4.2", "##source=a", '##INFO=<ID=DP,Number=1,Type=Integer,Description="x, ID=no">', "##contig=<ID=2>", "##SAMPLE=<Name=s>", "#CHROM\tPOS"]
B = ["##fileformat=VCFv4.3", "##tool=b", "##tool=c", '##FILTER=<ID=PASS,Description="p">', "##INFO=<ID=DP,Number=A,Type=Integer>", "##INFO=<ID=AC,Number=A,Type=Integer>", "##contig=<ID=1>", "##contig=<ID=2>", "##SAMPLE=<Name=t>"]


def _lines(spark, *files):
    return spark.createDataFrame([(f, k, x) for f, h in enumerate(files) for k, x in enumerate(h)], "file int, line_no long, line string")


def test_union(spark):
    x = _lines(spark, A, B)
    got = [r.line for r in headers.union(x).orderBy("file", "line_no").collect()]
    assert got == [*A[:5], B[1], B[2], B[3], B[5], B[6]]
    assert [(r.file, r.key, r.id) for r in headers.conflicts(x).collect()] == [(1, "INFO", "DP")]


def test_translation(spark):
    got = {(r.file, r.kind, r.id): (r.own, r.n) for r in headers.translation(_lines(spark, A, B)).collect()}
    assert got == {(0, "id", "DP"): (1, 1), (0, "contig", "2"): (0, 0), (1, "id", "PASS"): (0, 0), (1, "id", "DP"): (1, 1), (1, "id", "AC"): (2, 2), (1, "contig", "1"): (0, 1), (1, "contig", "2"): (1, 0)}


def test_no_lines(spark):
    x = _lines(spark, A).where("false")
    assert headers.union(x).count() == headers.conflicts(x).count() == headers.translation(x).count() == 0
