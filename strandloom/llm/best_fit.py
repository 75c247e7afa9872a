"""Bulk-synchronous best-fit packing of all documents into sequences of a fixed length.

Documents are tokenized and cut into pieces of at most the capacity. Pieces are ranked within their length by
a distributed count (ranks of a task's rows start after those of the tasks before it). Matching
then goes in supersteps over the range-sorted lengths, longest first: all pieces of a length and all gaps, sorted by
size, meet in a successor sweep: the ranks of the length take, in order, the smallest gaps that hold them; a
rank decides which piece gets which gap, so no two ask for the same one. Gaps are updated and the next superstep follows.

Pieces and gaps are run-length coded: a run is a length (or gap) and an interval of ranks (or
sequences). Best fit puts the next piece of the length into the gap that it has just cut, while that still holds one, so a gap of
size g takes g // l pieces before the next gap of its size is looked at; a superstep gives whole runs of gaps their pieces so, and the remainder
to one gap more. The result equals best-fit decreasing on single pieces (equal gaps are taken in any order).

The sweep over runs is the one part that is not distributed. Its state is bounded by the capacity, not by the data: there are at most ``capacity`` lengths
and gap sizes, and runs level off (README has figures), while every row is ranked and placed on the executors.

Defined results: a null or empty text is the end id alone; repeated rows and ids are separate documents; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import _text
from strandloom.llm._store import stored
from strandloom.llm.token_ids import default_path, ids_of

CAPACITY = 2048
PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, ids = TaskContext.get().partitionId() << 36, ids_of(path)
        for b in batches:
            names = b.column(0).to_pylist()
            data, offsets = _text.buffers(b.column(1))
            rows = []
            for k, name in enumerate(names):
                out = ids.document(data[offsets[k] : offsets[k + 1]].tobytes())
                for n, at in enumerate(range(0, len(out), 4 * capacity)):
                    own = out[at : at + 4 * capacity]
                    rows.append((row, name, n, at // 4, len(own) // 4, zlib.crc32(own)))
                    row += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if k == 2 else pa.int64()) for k, x in enumerate(zip(*rows))], names=["row", "doc_id", "piece", "start", "length", "ids_crc32"])
            _text.trim()

    return docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`").cast("string")).mapInArrow(run, PIECES)


def sweep(lengths: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, rank after the last, first sequence, pieces a sequence, offset of its first) from the number of pieces of each length."""
    gaps: list[int] = []  # sizes, sorted
    held: dict[int, list[tuple[int, int]]] = {}  # size -> runs of sequences (first, count)
    out, opened = [], 0

    def free(size: int, first: int, count: int) -> None:
        if size and count:
            if size not in held:
                bisect.insort(gaps, size)
                held[size] = []
            held[size].append((first, count))

    for length in sorted(lengths, reverse=True):
        rank, n = 0, lengths[length]
        while rank < n:
            at = bisect.bisect_left(gaps, length)
            size = gaps[at] if at < len(gaps) else capacity
            deep, left = size // length, n - rank
            if at < len(gaps):
                first, count = held[size].pop()
                took = min(count, -(-left // deep))
                if took < count:
                    held[size].append((first + took, count - took))
                elif not held[size]:
                    del held[size], gaps[at]
            else:  # no gap holds the length: new sequences
                first, took = opened, -(-left // deep)
                opened += took
            full = min(took, left // deep)
            put = min(left, took * deep)
            out.append((length, rank, rank + put, first, deep, capacity - size))
            free(size - deep * length, first, full)
            if full < took:  # the last one takes the remainder
                free(size - (put - full * deep) * length, first + full, 1)
            rank += put
    return out


def ranked(made: DataFrame) -> DataFrame:
    """rank: the row's place among all rows of its length, in order of row. No task holds a length; only a task's own rows of it are ranked together."""
    from pyspark.sql import Window

    part = F.shiftright("row", 36)
    n = made.groupBy("length", part.alias("part")).agg(F.count("*").alias("n"))
    before = n.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    own = made.withColumn("part", part).withColumn("own", F.row_number().over(Window.partitionBy("length", "part").orderBy("row")) - 1)
    return own.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("own")).drop("part", "own", "before")


def packed(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset."""
    spark = made.sparkSession
    lengths = {r.length: r.n for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    runs = sweep(lengths, capacity)
    plan = spark.createDataFrame(runs, "length long, lo long, hi long, first long, deep long, begin long")
    rows = ranked(made)
    nth = F.col("rank") - F.col("lo")
    on = (rows["length"] == plan["length"]) & (rows["rank"] >= plan["lo"]) & (rows["rank"] < plan["hi"])
    plan = F.broadcast(plan) if len(runs) <= 200_000 else plan
    return rows.join(plan, on).select(
        "doc_id", "piece", "start", rows["length"], "ids_crc32",
        (F.col("first") + (nth / F.col("deep")).cast("long")).alias("sequence_id"), (F.col("begin") + nth % F.col("deep") * rows["length"]).alias("offset"),
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return packed(stored(pieces(docs, doc_id, text, capacity, path), "pieces"), capacity)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)
