"""Alignments written as a folder of BAM files, one a task, each with the header, its index and the end mark.

A task writes below ``_attempts`` under a name of its own; the commit moves the files that tasks report to their places
and removes the folder, so that attempts that were lost or came second leave nothing behind. Sorted files come from
``written`` with ranges of (contig, position); their index is made on the way, since the writer knows where each block begins.

Defined results: a null or ``*`` in place of a contig, CIGAR, sequence or qualities is written as none; null numbers
as 0, null positions as -1; tags are written as integers, as arrays (``C,1,2``) or as strings, by their look; a table
without rows gives one file without records; a contig that the header doesn't name is an error.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from strandloom.sources import alignments, blocks

# The empty block that ends a file, bytes of a block's content.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
CONTENT = 0xFF00
_OPS = {op: k for k, op in enumerate("MIDNSHP=X")}
_OP = re.compile(r"\d+[MIDNSHP=X]")
# letters as hexadecimal digits of their codes, and qualities without their offset
_DIGITS = bytes(b"0123456789abcdef"["=ACMGRSVTWYHKDBN".find(chr(k).upper()) % 16] for k in range(256))
_PLAIN = bytes((k - 33) & 255 for k in range(256))
_HEAD = struct.Struct("<iiiBBHHHiiii")
_INTEGER, _ARRAY = re.compile(r"-?\d{1,10}"), re.compile(r"[cCsSiI](,-?\d+)+")
_COLUMNS = [c.split()[0] for c in alignments.SCHEMA.split(", ")]
_FIRST_OF_LEVEL = ((4681, 14), (585, 17), (73, 20), (9, 23), (1, 26))


def contigs_of(header: str) -> list[tuple[str, int]]:
    """(name, length) of the @SQ lines."""
    fields = [dict(x.split(":", 1) for x in line.split("\t")[1:]) for line in header.splitlines() if line.startswith("@SQ\t")]
    return [(f["SN"], int(f["LN"])) for f in fields]


def header_of(contigs: list[tuple[str, int]], program: str = "strandloom", command: str = "") -> str:
    lines = ["@HD\tVN:1.6\tSO:coordinate", *(f"@SQ\tSN:{n}\tLN:{k}" for n, k in contigs)]
    return "\n".join([*lines, f"@PG\tID:{program}\tPN:{program}" + (f"\tCL:{command}" if command else "")]) + "\n"


def with_program(header: str, program: str, command: str = "") -> str:
    """The header with one more program line, which follows each last one of the chains that are there."""
    lines = header.rstrip("\n").split("\n")
    own = [dict(x.split(":", 1) for x in line.split("\t")[1:]) for line in lines if line.startswith("@PG\t")]
    taken, before = {f["ID"] for f in own}, {f.get("PP") for f in own}
    for last in [f["ID"] for f in own if f["ID"] not in before] or [None]:
        name, n = program, 1
        while name in taken:
            name, n = f"{program}.{n}", n + 1
        taken.add(name)
        lines.append(f"@PG\tID:{name}\tPN:{program}" + (f"\tPP:{last}" if last else "") + (f"\tCL:{command}" if command else ""))
    return "\n".join(lines) + "\n"


def smallest_bin(begin: int, end: int) -> int:
    """The bin of the deepest level that holds begin to end (exclusive) whole."""
    for first, bits in _FIRST_OF_LEVEL:
        if begin >> bits == (end - 1) >> bits:
            return first + (begin >> bits)
    return 0


def _tag(key: str, value: str) -> bytes:
    head = key.encode()
    if _INTEGER.fullmatch(value) and -(1 << 31) <= int(value) < 1 << 31:
        return head + b"i" + struct.pack("<i", int(value))
    if _ARRAY.fullmatch(value):
        kind, *rest = value.split(",")
        return head + b"B" + kind.encode() + struct.pack(f"<I{len(rest)}{alignments._TYPES[kind]}", len(rest), *map(int, rest))
    return head + b"Z" + value.encode() + b"\0"


@lru_cache(1 << 16)
def _op(text: str) -> tuple[int, int]:
    """(code, bases of the reference) of an operation."""
    n, op = int(text[:-1]), text[-1]
    return n << 4 | _OPS[op], n if op in "MDN=X" else 0


def _qualities(text: str) -> bytes:
    """Qualities without their offset; one below it is an error."""
    if text.isascii() and min(text, default="!") >= "!":
        return text.encode().translate(_PLAIN)
    return bytes([ord(c) - 33 for c in text])


def encoded(row: tuple, refs: dict[str, int]) -> tuple[bytes, int, int, int]:
    """(record with its length field, contig, begin, end) of a row of alignments.SCHEMA, its tags as pairs."""
    qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, tags = row
    ref = -1 if rname in (None, "*") else refs[rname]
    mate = ref if rnext == "=" else -1 if rnext in (None, "*") else refs[rnext]
    ops = [_op(x) for x in _OP.findall(cigar)] if cigar else []
    seq = "" if seq in (None, "*") else seq
    # letters beyond one byte have no code, as unknown ones
    packed = bytes.fromhex((seq.encode("latin-1", "replace").translate(_DIGITS) + b"0" * (len(seq) % 2)).decode())
    qual = b"\xff" * len(seq) if qual in (None, "*") or len(qual) != len(seq) else _qualities(qual)
    pos, flag = -1 if pos is None else pos, flag or 0
    end = pos + max(1, sum([n for _, n in ops]) if not flag & 4 else 0)
    name = (qname or "*").encode() + b"\0"
    own = b"".join([_tag(k, v) for k, v in sorted(tags) if v is not None]) if tags else b""
    head = _HEAD.pack(
        32 + len(name) + 4 * len(ops) + len(packed) + len(qual) + len(own),
        ref, pos, len(name), mapq or 0, smallest_bin(max(0, pos), max(1, end)), len(ops), flag, len(seq), mate, -1 if pnext is None else pnext, tlen or 0,
    )
    return head + name + struct.pack(f"<{len(ops)}I", *[code for code, _ in ops]) + packed + qual + own, ref, pos, end


def _values(c: pa.Array) -> list:
    """A column's values, maps as lists of pairs."""
    if isinstance(c, pa.MapArray):
        pairs, at = list(zip(_values(c.keys), _values(c.items))), c.offsets.to_pylist()
        values = [pairs[a:z] for a, z in zip(at, at[1:])]
        return [v if ok else None for v, ok in zip(values, c.is_valid().to_pylist())] if c.null_count else values
    return c.to_pylist() if c.null_count else c.to_numpy(zero_copy_only=False).tolist()


class _Out:
    """A block-gzipped stream; knows the virtual offset of the next byte."""

    def __init__(self, stream):
        self.stream, self.at, self.held = stream, 0, bytearray()

    def place(self) -> int:
        return self.at << 16 | len(self.held)

    def flush(self) -> None:
        if self.held:
            d = zlib.compressobj(6, zlib.DEFLATED, -15)
            body = d.compress(bytes(self.held)) + d.flush()
            block = struct.pack("<4BI2BH2sHH", 31, 139, 8, 4, 0, 0, 255, 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(bytes(self.held)), len(self.held))
            self.stream.write(block)
            self.at += len(block)
            self.held = bytearray()

    def write(self, data: bytes) -> None:
        if self.held and len(self.held) + len(data) > CONTENT:
            self.flush()
        for k in range(0, len(data), CONTENT):
            self.held += data[k : k + CONTENT]
            if len(self.held) >= CONTENT:
                self.flush()


class _Index:
    """Bins and windows of one file; None once records come out of order."""

    def __init__(self, n: int):
        self.bins, self.windows, self.last, self.sorted = [{} for _ in range(n)], [{} for _ in range(n)], (-1, -1), True

    def add(self, ref: int, begin: int, end: int, a: int, z: int) -> None:
        key = (ref if ref >= 0 else 1 << 31, begin)
        self.sorted &= key >= self.last
        self.last = key
        if ref < 0:
            return
        own = self.bins[ref].setdefault(smallest_bin(max(0, begin), end), [])
        if own and own[-1][1] == a:
            own[-1] = (own[-1][0], z)
        else:
            own.append((a, z))
        for w in range(max(0, begin) >> 14, ((end - 1) >> 14) + 1):
            self.windows[ref].setdefault(w, a)

    def data(self) -> bytes:
        out = [b"BAI\1", struct.pack("<i", len(self.bins))]
        for bins, windows in zip(self.bins, self.windows):
            out.append(struct.pack("<i", len(bins)))
            out += [struct.pack("<Ii", b, len(c)) + b"".join(struct.pack("<QQ", *x) for x in c) for b, c in sorted(bins.items())]
            n, before = max(windows, default=-1) + 1, 0
            out.append(struct.pack("<i", n))
            for w in range(n):
                before = windows.get(w, before)
                out.append(struct.pack("<Q", before))
        return b"".join(out)


@dataclass
class _Written(WriterCommitMessage):
    part: int
    name: str
    records: int
    indexed: bool


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, header: str):
        self.path, self.header = path.rstrip("/"), header

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        store, at = alignments._store(self.path)
        store.create_dir(f"{at}/_attempts", recursive=True)
        contigs = contigs_of(self.header)
        refs, index = {n: k for k, (n, _) in enumerate(contigs)}, _Index(len(contigs))
        name, n, text = uuid.uuid4().hex, 0, self.header.encode()
        with store.open_output_stream(f"{at}/_attempts/{name}.bam") as stream:
            out = _Out(stream)
            out.write(b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(contigs)) + b"".join(struct.pack("<i", len(c.encode()) + 1) + c.encode() + b"\0" + struct.pack("<i", k) for c, k in contigs))
            out.flush()
            for row in (r for b in batches for r in zip(*[_values(b.column(c)) for c in _COLUMNS])):
                data, ref, begin, end = encoded(row, refs)
                if len(out.held) + len(data) > CONTENT:
                    out.flush()
                place, n = out.place(), n + 1
                out.write(data)
                index.add(ref, begin, end, place, out.place())
            out.flush()
            stream.write(END)
        if index.sorted:
            with store.open_output_stream(f"{at}/_attempts/{name}.bam.bai") as stream:
                stream.write(index.data())
        return _Written(TaskContext.get().partitionId(), name, n, index.sorted)

    def commit(self, messages) -> None:
        store, at = alignments._store(self.path)
        made = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        kept = [m for m in made if m.records] or made[:1]  # ranges without records leave no file
        for k, m in enumerate(kept):
            for end in (".bam", ".bam.bai") if m.indexed else (".bam",):
                store.move(f"{at}/_attempts/{m.name}{end}", f"{at}/part-{k:05d}{end}")
        store.delete_dir(f"{at}/_attempts")

    def abort(self, messages) -> None:
        from pyarrow import fs

        store, at = alignments._store(self.path)
        if store.get_file_info(f"{at}/_attempts").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/_attempts")


class BamSink(DataSource):
    """df.write.format("bam_files").option("header", text).mode("append").save(path)."""

    @classmethod
    def name(cls) -> str:
        return "bam_files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options["header"])


def written(reads: DataFrame, path: str, header: str, partitions: int | None = None) -> None:
    """Writes rows of alignments.SCHEMA, sorted by contig in the header's order, position and name, as BAM files whose names follow that order."""
    spark: SparkSession = reads.sparkSession
    spark.dataSource.register(BamSink)
    order = F.array_position(F.array(*[F.lit(n) for n, _ in contigs_of(header)]), F.coalesce("rname", F.lit("*")))
    key = F.when(order == 0, F.lit(1 << 30)).otherwise(order)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = reads.select(*_COLUMNS, key.alias("_c"))
    own = own.repartitionByRange(n, "_c", "pos", "qname").sortWithinPartitions("_c", "pos", "qname").drop("_c")
    own.write.format("bam_files").option("header", header).mode("append").save(path)
