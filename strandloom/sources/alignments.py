"""Alignments: SAM text, and BAM through a Python data source."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from strandloom.sources import blocks

SCHEMA = "qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string, tags map<string,string>"
_OPS, _BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
_OF_DIGIT = bytes.maketrans(b"0123456789abcdef", _BASES.encode())
_HEAD = struct.Struct("<iiBBHHHiiii")
_QUALITIES = bytes((k + 33) & 255 for k in range(256))
# Struct codes of the types of tags.
_TYPES = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
_NUMBER = {ord(k): struct.Struct("<" + v) for k, v in _TYPES.items()}


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Records in file order (aln_id grows); pos and pnext are 0-based."""
    x = spark.read.text(path).where(~F.startswith("value", F.lit("@")) & (F.length("value") > 0)).select(F.monotonically_increasing_id().alias("aln_id"), F.split("value", "\t").alias("f"))
    at = lambda k: F.element_at("f", k)
    tags = F.map_from_entries(F.transform(F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2), F.regexp_replace(t, "^..:.:", ""))))
    return x.select("aln_id", at(1).alias("qname"), at(2).cast("int").alias("flag"), at(3).alias("rname"), (at(4).cast("long") - 1).alias("pos"), at(5).cast("int").alias("mapq"), at(6).alias("cigar"), at(7).alias("rnext"), (at(8).cast("long") - 1).alias("pnext"), at(9).cast("long").alias("tlen"), at(10).alias("seq"), at(11).alias("qual"), tags.alias("tags"))


def sam_lines(reads: DataFrame) -> DataFrame:
    """(aln_id, line); tags are written as integers or strings."""
    kind = lambda v: F.when(v.rlike(r"^-?\d+$"), "i").otherwise("Z")
    tags = F.transform(F.array_sort(F.map_entries("tags")), lambda t: F.concat(t["key"], F.lit(":"), kind(t["value"]), F.lit(":"), t["value"]))
    cells = ["qname", F.col("flag").cast("string"), "rname", (F.col("pos") + 1).cast("string"), F.col("mapq").cast("string"), "cigar", "rnext", (F.col("pnext") + 1).cast("string"), F.col("tlen").cast("string"), "seq", "qual"]
    return reads.select("aln_id", F.concat_ws("\t", *cells, tags).alias("line"))


def tagged(reads: DataFrame, judged: DataFrame) -> DataFrame:
    """reads with HP, PS and PQ of judged (aln_id, hp, ps, pq) in place of old ones."""
    j = judged.where("hp > 0").select("aln_id", "hp", "ps", "pq")
    kept = F.map_filter("tags", lambda k, v: ~k.isin("HP", "PS", "PQ"))
    new = F.map_from_arrays(F.array(F.lit("HP"), F.lit("PS"), F.lit("PQ")), F.array(*[F.col(c).cast("string") for c in ("hp", "ps", "pq")]))
    x = reads.join(j, "aln_id", "left")
    return x.withColumn("tags", F.when(F.col("hp").isNotNull(), F.map_concat(kept, new)).otherwise(kept)).drop("hp", "ps", "pq")


def index_statistics(reads: DataFrame) -> DataFrame:
    """Mapped and unmapped records by contig."""
    un = F.col("flag").bitwiseAND(4) != 0
    return reads.groupBy("rname").agg(F.count_if(~un).alias("mapped"), F.count_if(un).alias("unmapped"))


def inflated(data: bytes) -> bytes:
    """All members of a block-gzipped or gzipped file."""
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        data = d.unused_data
    return b"".join(out)


def bam_header(data: bytes) -> tuple[str, list[tuple[str, int]], int]:
    """Header text, contigs with their lengths, and the place of the first record in an inflated BAM; struct.error where data ends before."""
    if data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    (n,) = struct.unpack_from("<i", data, at)
    text, at, contigs = data[8:at].rstrip(b"\0").decode(), at + 4, []
    for _ in range(n):
        (k,) = struct.unpack_from("<i", data, at)
        contigs.append((data[at + 4 : at + 3 + k].decode(), struct.unpack_from("<i", data, at + 4 + k)[0]))
        at += 8 + k
    return text, contigs, at


@lru_cache(1 << 16)
def _op(code: int) -> str:
    return f"{code >> 4}{_OPS[code & 15]}"


def bam_record(data: bytes, names: list[str]) -> tuple:
    """A row of SCHEMA from a record without its length field."""
    name = lambda k: names[k] if k >= 0 else "*"
    ref, pos, n_name, mapq, _, n_cigar, flag, n_seq, next_ref, next_pos, tlen = _HEAD.unpack_from(data)
    k, end = 32, len(data)
    qname = data[k : k + n_name - 1].decode()
    k += n_name
    cigar = "".join(map(_op, struct.unpack_from(f"<{n_cigar}I", data, k))) or "*"
    k += 4 * n_cigar
    seq = data[k : k + (n_seq + 1) // 2].hex().encode().translate(_OF_DIGIT).decode()[:n_seq] or "*"
    k += (n_seq + 1) // 2
    raw = data[k : k + n_seq]
    qual = "*" if not raw or raw[0] == 255 else raw.translate(_QUALITIES).decode("latin-1")
    k += n_seq
    tags = {}
    while k < end:
        key, kind = data[k : k + 2].decode(), data[k + 2]
        k += 3
        if (number := _NUMBER.get(kind)) is not None:
            tags[key], k = str(number.unpack_from(data, k)[0]), k + number.size
        elif kind in b"ZH":
            stop = data.index(0, k)
            tags[key], k = data[k:stop].decode(), stop + 1
        elif kind == 65:  # A
            tags[key], k = chr(data[k]), k + 1
        elif kind == 66:  # B
            sub, count = chr(data[k]), struct.unpack_from("<I", data, k + 1)[0]
            values = struct.unpack_from(f"<{count}{_TYPES[sub]}", data, k + 5)
            tags[key] = ",".join([sub, *map(str, values)])
            k += 5 + count * struct.calcsize(_TYPES[sub])
        else:
            raise KeyError(chr(kind))
    mate = "=" if next_ref == ref and ref >= 0 else name(next_ref)
    return qname, flag, name(ref), pos, mapq, cigar, mate, next_pos, tlen, seq, qual, tags


def bam_records(data: bytes) -> Iterator[tuple]:
    """Rows of SCHEMA from an inflated BAM."""
    _, contigs, at = bam_header(data)
    names = [c for c, _ in contigs]
    while at < len(data):
        (size,) = struct.unpack_from("<i", data, at)
        yield bam_record(data[at + 4 : at + 4 + size], names)
        at += 4 + size


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """BAM files below a path, from any store that Spark reads; a file is one task's. scan_bam() splits files."""

    def run(batches):
        import pandas as pd

        for b in batches:
            for n, data in zip(b["n"], b["content"]):
                task, nth = int(n) >> 33, int(n) & ((1 << 33) - 1)  # a task's files are few: Spark packs small ones up to a size
                if task >= 1 << 17 or nth >= 1 << 10:
                    raise ValueError("too many files for one read")
                rows = [(task << 46 | nth << 36 | k, *r) for k, r in enumerate(bam_records(inflated(bytes(data))))]
                for k in range(0, len(rows), 20_000):
                    yield pd.DataFrame(rows[k : k + 20_000], columns=["aln_id", *[c.split()[0] for c in SCHEMA.split(", ")]])

    files = spark.read.format("binaryFile").load(path).select(F.monotonically_increasing_id().alias("n"), "content")
    return files.mapInPandas(run, f"aln_id long, {SCHEMA}")


_FIELDS = pa.schema(
    [("qname", pa.string()), ("flag", pa.int32()), ("rname", pa.string()), ("pos", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("rnext", pa.string()), ("pnext", pa.int64())]
    + [("tlen", pa.int64()), ("seq", pa.string()), ("qual", pa.string()), ("tags", pa.map_(pa.string(), pa.string())), ("file", pa.string()), ("voffset", pa.int64())]
)
#: Rows of a batch that a task hands on, and bytes of a split.
BATCH, STEP = 1000, 1 << 25


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of _FIELDS, their tags as dictionaries."""
    columns = dict(zip(_FIELDS.names, zip(*rows)))
    tags = columns.pop("tags")
    own = pa.array(accumulate(map(len, tags), initial=0), pa.int32())
    made = {c: pa.array(v, _FIELDS.field(c).type) for c, v in columns.items()}
    made["tags"] = pa.MapArray.from_arrays(own, pa.array([k for t in tags for k in t], pa.string()), pa.array([v for t in tags for v in t.values()], pa.string()))
    return pa.RecordBatch.from_arrays([made[c] for c in _FIELDS.names], schema=_FIELDS)


@dataclass
class _Part(InputPartition):
    path: str
    size: int
    split: blocks.Split | None  # None: not of blocks, read whole
    contigs: list


def _store(path: str):
    """File system and path: whatever pyarrow opens by address (local, hdfs, s3, gs), the same on driver and executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _files(path: str) -> list[tuple[str, int]]:
    """(address, bytes) of the files that a path, folder or pattern of the last name stands for, in order."""
    import fnmatch

    from pyarrow import fs

    head, _, last = path.rpartition("/")
    pattern = last if any(c in last for c in "*?[") else None
    store, at = _store(head if pattern else path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at))
    prefix = path.split("://")[0] + "://" if "://" in path else ""
    return sorted((prefix + x.path, x.size) for x in found if x.type == fs.FileType.File and (fnmatch.fnmatch(x.base_name, pattern) if pattern else info.type == fs.FileType.File or x.base_name.endswith(".bam")))


def parsed_region(text: str) -> tuple[str, int, int]:
    """name, name:begin or name:begin-end in places from 1, as (name, begin, end) from 0, end exclusive."""
    name, colon, span = text.rpartition(":")
    if not colon or not re.fullmatch(r"[\d,]+(-[\d,]*)?", span):
        return text, 0, 1 << 31
    a, dash, z = span.replace(",", "").partition("-")
    return name, max(0, int(a) - 1), int(z) if z else 1 << 31


class _Reader(DataSourceReader):
    """Splits of the files; with a region, those of the blocks that the index leads to."""

    def __init__(self, options: dict):
        self.path, self.step, self.report = options["path"], int(options.get("step", STEP)), options.get("report", "false") == "true"
        self.region = parsed_region(options["region"]) if options.get("region") else None
        self.asked: tuple[str, int, int] | None = None

    def partitions(self):
        out = []
        for path, size in _files(self.path):
            store, at = _store(path)
            head = blocks.Content(blocks.Bytes(lambda: store.open_input_file(at), 0, size, size))  # noqa: B023
            if not blocks.block_size(head.f.take(280)):
                out.append(_Part(path, size, None, []))
                continue
            while True:
                if not head.more():
                    raise ValueError(f"{path} ends within its header")
                try:
                    _, contigs, first = bam_header(head.data)
                    break
                except (struct.error, IndexError):  # the header goes on
                    continue
            names = [c for c, _ in contigs]
            found = None
            for name, begin, end in [x for x in (self.region, self.asked) if x]:
                ref = names.index(name) if name in names else None
                index = next((store.open_input_file(x).read() for x in (at + ".bai", at.removesuffix(".bam") + ".bai") if store.get_file_info(x).type.name == "File"), None)
                if ref is None and (name != "*" or self.region == (name, begin, end)) or begin >= end:
                    found = []
                elif index is not None and ref is not None and found is None:
                    found = blocks.chunks(index, ref, begin, end)
            step = self.step or size + 1
            out += [_Part(path, size, s, contigs) for s in blocks.splits(size, head.offset(first), step, found)]
            head.f.close()
        return out or [_Part("", 0, None, [])]

    def read(self, part):
        if not part.path:
            return
        store, at = _store(part.path)
        read, n, rows = 0, 0, []

        def seen(f):
            nonlocal read
            read += f.read

        def raw():
            nonlocal read
            if part.split is None:
                data = store.open_input_file(at).read()
                read += len(data)
                yield from enumerate(bam_records(inflated(data)))
                return
            for place, data in blocks.records(lambda: store.open_input_file(at), part.size, part.split, [k for _, k in part.contigs], seen):
                yield place, bam_record(data, names)

        names = [c for c, _ in part.contigs]
        for place, row in raw():
            if self.region and not _over(row, *self.region):
                continue
            n += 1
            if self.report:
                continue
            rows.append((*row, part.path, place))
            if len(rows) == BATCH:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)
        if self.report:
            yield (part.path, part.split.after if part.split else 0, read, n)


class _PushedReader(_Reader):
    """Also takes filters, which Spark offers only where spark.sql.python.filterPushdown.enabled is set."""

    def pushFilters(self, filters):
        """Equality of rname and bounds of pos narrow the blocks that are read; Spark applies all filters again."""
        name, least, most = None, 0, 1 << 31
        for f in filters:
            at, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if at == ("rname",) and isinstance(f, EqualTo):
                name = value
            if at == ("pos",) and isinstance(value, int):
                least = max(least, value + isinstance(f, GreaterThan)) if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) else least
                most = min(most, value + (not isinstance(f, LessThan))) if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) else most
        if name is not None:
            self.asked = (name, max(0, least), most)
        return filters


def _over(row: tuple, name: str, begin: int, end: int) -> bool:
    """Whether a record lies over a region; one without reference bases is one base long."""
    if row[2] != name:
        return False
    n = sum(int(k) for k, op in re.findall(r"(\d+)([MDN=X])", row[5])) if not row[1] & 4 else 0
    return row[3] < end and row[3] + max(1, n) > begin


class BamSource(DataSource):
    """spark.read.format("bam_records").load(path): BAM files, folders of them or patterns, split by runs of blocks.

    Options: ``region`` (name, name:begin or name:begin-end, from 1) keeps records over a region, and reads only the blocks
    that the file's .bai names, where there is one; ``step``, bytes of a split (0: none); ``report`` returns instead of records a row
    a split with the bytes read and the records found; ``pushdown``, with spark.sql.python.filterPushdown.enabled: filters on rname and pos narrow the blocks as well."""

    @classmethod
    def name(cls) -> str:
        return "bam_records"

    def schema(self) -> str:
        return "file string, begin long, bytes long, records long" if self.options.get("report", "false") == "true" else SCHEMA + ", file string, voffset long"

    def reader(self, schema) -> DataSourceReader:
        return (_PushedReader if self.options.get("pushdown", "false") == "true" else _Reader)(dict(self.options))


def scan_bam(spark: SparkSession, path: str, region: str | None = None, step: int = STEP) -> DataFrame:
    """Records of BAM files by splits, in any store that pyarrow opens: SCHEMA, file, voffset. read_bam() reads what only Spark can open."""
    spark.dataSource.register(BamSource)
    own = spark.read.format("bam_records").option("step", step).option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    return (own.option("region", region) if region else own).load(path)
