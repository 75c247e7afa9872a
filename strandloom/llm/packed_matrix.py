"""Token-id output: packed id matrices with cumulative segment lengths and position resets.

Each task tokenizes its documents, cuts those over the capacity into pieces without losing an id, and packs a shard of
about ``SHARD_TOKENS`` ids at a time by best-fit decreasing. A segment tree over remaining
capacities, one leaf a capacity, gives the fullest open row that still holds a piece. Rows less than
``FULL`` filled aren't written; their pieces go on into the task's next shard. Nothing is shuffled and
a task holds one shard.

A row of the result is one row of the matrix: ``ids`` (capacity little-endian unsigned 32-bit ids, padded
with ``PAD``), ``cu_seqlens`` (0, then the end of each segment), ``position_resets`` (where positions start at
0 again), and each segment's document, piece and first id.

Defined results: a null or empty text is the end id alone; repeated rows are packed one by one; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import _text
from strandloom.llm._store import bounded
from strandloom.llm.token_ids import default_path, ids_of

CAPACITY = 2048
PAD = 0
SHARD_TOKENS = 1 << 22
FULL = 0.98

SCHEMA = "sequence_id long, n_tokens int, n_segments int, ids binary, ids_crc32 long, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, pieces array<int>, starts array<long>"


class CapacityTree:
    """Counts of open rows by remaining capacity; finds the smallest remaining capacity of at least a need."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.base)

    def add(self, remaining: int, n: int) -> None:
        k = self.base + remaining
        while k:
            self.count[k] += n
            k >>= 1

    def find(self, need: int) -> int | None:
        k, count = self.base + need, self.count
        if count[k]:
            return need
        while k > 1:  # up to the first subtree on the right that has rows
            if not k & 1 and count[k + 1]:
                k += 1
                break
            k >>= 1
        else:
            return None
        while k < self.base:
            k = 2 * k if count[2 * k] else 2 * k + 1
        return k - self.base


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of places in lengths."""
    tree, open_rows, rows = CapacityTree(capacity), {}, []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        n = lengths[k]
        left = tree.find(n)
        if left is None:
            row, left = len(rows), capacity
            rows.append([])
        else:
            row = open_rows[left].pop()
            tree.add(left, -1)
        rows[row].append(k)
        if left > n:
            open_rows.setdefault(left - n, []).append(row)
            tree.add(left - n, 1)
    return rows


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, doc_id: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    path = path or default_path()
    bounded(docs.sparkSession)

    def shard(held: list, number: int, last: bool) -> tuple[pa.RecordBatch | None, list, int]:
        out, rest = [], []
        for row in best_fit_decreasing([len(x[3]) // 4 for x in held], capacity):
            own = [held[k] for k in row]
            ids = b"".join(x[3] for x in own)
            if not last and len(ids) < FULL * 4 * capacity:
                rest += own
                continue
            ends = np.cumsum([0] + [len(x[3]) // 4 for x in own]).tolist()
            matrix = ids + PAD.to_bytes(4, "little") * (capacity - len(ids) // 4)
            out.append((number, len(ids) // 4, len(own), matrix, zlib.crc32(ids), ends, ends[:-1], [x[0] for x in own], [x[1] for x in own], [x[2] for x in own]))
            number += 1
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), *[pa.list_(pa.int32())] * 2, pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return (pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], names=names) if out else None), rest, number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, held, total = TaskContext.get().partitionId() << 36, ids_of(path), [], 0
        for b in batches:
            names = b.column(0).to_pylist()
            data, offsets = _text.buffers(b.column(1))
            for k, name in enumerate(names):
                out = ids.document(data[offsets[k] : offsets[k + 1]].tobytes())
                for n, at in enumerate(range(0, len(out), 4 * capacity)):
                    held.append((name, n, at // 4, out[at : at + 4 * capacity]))
                total += len(out) // 4
                if total >= shard_tokens:
                    made, held, number = shard(held, number, False)
                    total = sum(len(x[3]) // 4 for x in held)
                    if made:
                        yield made
                    if total >= shard_tokens // 2:  # nothing fits together any better
                        made, held, number = shard(held, number, True)
                        total = 0
                        yield made
        if held:
            yield shard(held, number, True)[0]

    return docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`").cast("string")).mapInArrow(run, SCHEMA)


def write(packed: DataFrame, path: str) -> None:
    packed.write.parquet(path)


def unpacked(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, ids) of each segment, cut out of the matrix again."""
    k = F.posexplode(F.slice("cu_seqlens", 1, F.size("cu_seqlens") - 1)).alias("k", "first")
    seg = packed.select("*", k)
    at = lambda c: F.element_at(c, F.col("k") + 1)
    length = F.element_at("cu_seqlens", F.col("k") + 2) - F.col("first")
    return seg.select(at("doc_ids").alias("doc_id"), at("pieces").alias("piece"), at("starts").alias("start"), F.expr("substring(ids, 4 * first + 1, 4 * (element_at(cu_seqlens, k + 2) - first))").alias("ids"), length.alias("length"))


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
