"""Interaction audit of document filters over a fingerprint-routed RDD.

Every text is judged once: bits of the filters that it fails by itself, and one for being a copy. Copies are found by
routing texts by xxhash to partitions that store collision chains: full texts of one fingerprint, each with its
smallest id. A task first chains its own texts and sends of each only the rows of the smallest id (all others are
copies already), so that a text reaches a partition once a task, however often it occurs. ``combineByKey`` then merges
vectors of counts by bits, and every order of the filters is computed from a part's 2^filters counts alone.

A chain holds texts of one fingerprint; a task holds at most ``HELD`` bytes of texts before it sends them, and
partitions of chains are as many as the bytes of all texts ask for.

Defined results: a null text is an empty one and a null part an empty string; a null id counts as larger than any
other, and rows that share the smallest id are none of them copies; labels that name an id more than once count if any
of them does, those of a null id never; repeated rows are counted one by one; an empty table gives no part; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of texts that a task holds at most, and that a partition of chains is to hold about.
HELD = 1 << 25
#: Names of the filters; a filter's bit is its place.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
_UPPER, _SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def own_bits(data: bytes) -> int:
    """Bits of the filters that a UTF-8 text fails by itself."""
    words = data.split()  # at space and \t to \r
    points = len(data) - len(data.translate(None, bytes(range(128, 192)))) if not data.isascii() else 0
    upper = len(data) - len(data.translate(None, _UPPER))
    return (
        (len(words) < 200)
        | (100 * len(set(words)) < 50 * len(words)) << 1
        | (100 * upper > 2 * (len(data) - points)) << 2
        | (len(data.translate(None, _SYMBOLS)) < len(data)) << 3
    )


def fingerprint(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data)


def _order(name: int | None) -> tuple:
    return (name is None, name)


class Chains:
    """Texts by fingerprint, each with the rows (id, part, bits) of its smallest id."""

    def __init__(self):
        self.of: dict[int, list] = {}
        self.held = 0

    def add(self, key: int, data: bytes, rows: list) -> list:
        """Rows that are copies now."""
        chain = self.of.setdefault(key, [])
        for link in chain:
            if link[0] == data:
                new, old = _order(rows[0][0]), _order(link[1][0][0])
                if new == old:
                    link[1] += rows
                    return []
                lost = link[1] if new < old else rows
                if new < old:
                    link[1] = rows
                return lost
        chain.append([data, rows])
        self.held += len(data) + 100
        return []

    def links(self) -> Iterator[tuple[int, bytes, list]]:
        for key, chain in self.of.items():
            for data, rows in chain:
                yield key, data, rows


def ledger(docs: RDD, partitions: int, hashed: Callable[[bytes], int] = fingerprint, held: int = HELD) -> RDD:
    """docs: (id, part, text). (id, part, bits) of every row, copies with their bit."""

    def local(rows: Iterable) -> Iterator:
        chains, n = Chains(), 0
        for name, part, text in rows:
            data = (text or "").encode("utf-8", "surrogatepass")
            row = (name, part or "", own_bits(data))
            key = hashed(data)
            for lost in chains.add(key, data, [row]):
                n += 1  # dealt in turn: copies go through the same shuffle, but not to the partition of their text
                yield n, None, [lost]
            if chains.held > held:
                yield from chains.links()
                chains = Chains()
        yield from chains.links()

    def merged(rows: Iterable) -> Iterator:
        chains = Chains()
        for key, (data, own) in rows:
            for name, part, bits in own if data is None else chains.add(key, data, own):
                yield name, part, bits | COPY
        for _, _, own in chains.links():
            yield from own

    routed = docs.mapPartitions(local).map(lambda x: (x[0], x[1:]))
    return routed.partitionBy(partitions, lambda key: key).mapPartitions(merged)


def vectors(rows: RDD, partitions: int, filters: int = len(FILTERS)) -> RDD:
    """rows: (part, bits, is good, is toxic). (part, counts by kind of row and bits): all, good and toxic ones."""
    n = 1 << filters

    def add(v: list, x: tuple) -> list:
        bits, good, toxic = x
        v[bits] += 1
        if good:
            v[n + bits] += 1
        if toxic:
            v[2 * n + bits] += 1
        return v

    return rows.map(lambda r: (r[0], (r[1], r[2], r[3]))).combineByKey(lambda x: add([0] * (3 * n), x), add, lambda a, b: [x + y for x, y in zip(a, b)], partitions)


def orders(part: str, counts: list, names: str = FILTERS) -> Iterator[tuple]:
    """Rows of REPORT from the counts of one part."""
    n = len(names)
    every, good, toxic = np.array(counts, np.int64).reshape(3, 1 << n)
    bits = np.arange(1 << n)
    fails = [(bits >> k & 1).astype(bool) for k in range(n)]
    only = [int(every[1 << k]) for k in range(n)]
    out, total = [], [0] * n
    for order in permutations(range(n)):
        alive = np.ones(1 << n, bool)
        for step, k in enumerate(order, 1):
            gone = alive & fails[k]
            removed = int(every[gone].sum())
            total[k] += removed
            redundant = int(every[fails[k] & ~alive].sum())
            alive = alive & ~fails[k]
            out.append((k, part, "".join(names[j] for j in order), step, int(every[alive].sum()), removed, redundant, only[k], int(good[gone].sum()), int(toxic[gone].sum())))
    for k, *row in out:
        yield *row, total[k]


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source", hashed: Callable[[bytes], int] = fingerprint, held: int = HELD) -> DataFrame:
    """REPORT: a row a part, order of the filters and step."""
    spark = docs.sparkSession
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{part}`").cast("string").alias("part"), F.col(f"`{text}`").cast("string").alias("text"))
    size = own.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(spark.sparkContext.defaultParallelism, -(-size // HELD))
    rows = spark.createDataFrame(ledger(own.rdd, n, hashed, held), "doc_id long, part string, bits int")
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = rows.join(marks, "doc_id", "left").select("part", "bits", "good", "toxic")
    return spark.createDataFrame(vectors(known.rdd, n).flatMap(lambda x: orders(*x)), REPORT)


def query(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
