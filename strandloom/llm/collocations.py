"""Phrases whose words stand together more often than apart, by merged count-min sketches and an exact second pass.

Texts are cut at ``STOPS`` into pieces and those into words; a phrase lies within a piece, and all is counted by
language. Tasks fill count-min sketches of saturating one-byte counters, which are merged block by block: first for
words and pairs, then for phrases of three to ``longest`` words, and of these only such whose pairs all reach ``least``
in the first sketch. Counters only overestimate, so whatever occurs ``least`` times survives. The second pass counts
the survivors exactly, by their text, and what doesn't reach ``least`` goes. Only cells that reach ``least`` are
sent to tasks, one bit each.

A sketch has about a cell for every ``SPREAD`` letters of the corpus, and 2^MAX_BITS a row at most, so that a task's memory
is bounded. A sketch too narrow for its corpus lets more phrases through to the exact count; it loses none.

The score of a phrase is the least over its cuts of ``1000 * a * n / (l * r)``, rounded down, in decimals of 38
digits. A candidate is subsumed if a longer one that holds it has ``percent`` of its occurrences; it is enough to look
at those with one more word, since what lies between occurs at least as often as the longer one.

Defined results: a null or empty text has no words; a null language is ``und``; repeated rows count each; the id plays
no part; a table without words gives no rows; extra columns are ignored; a text is worked on in parts of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm import _text
from strandloom.llm._store import bounded, stored

LEAST, LONGEST, PERCENT, TOP = 100, 5, 100, 2000
STOPS = b".,;:!?\n\v\f\r"
SPREAD, MAX_BITS, LEAST_BITS = 32, 27, 16
#: Cells of a block, by which sketches are merged.
BLOCK = 1 << 18
#: Phrases that a task holds before it hands them on, and words that are worked on at a time.
HELD, PART = 1 << 19, 1 << 17
#: Bytes of text of a task, about, where that makes more tasks than there are cores: it fills one sketch of no more bytes.
TASK_BYTES = 1 << 28
_WORD = np.ones(256, bool)
_WORD[[32, 9, *STOPS]] = False
_STOP = np.zeros(256, bool)
_STOP[list(STOPS)] = True


@dataclass
class Words:
    """Words of some texts in order: hashes, byte places from start to end, and pieces, which no two texts share."""

    data: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray


def _words(data: np.ndarray, bounds: np.ndarray) -> Words:
    """bounds: where texts begin."""
    low = _text.FOLD[data]
    hashes, start = _text._hashes(data, bounds, _WORD, _text.FOLD)
    out = np.flatnonzero(~_WORD[low])
    text = np.searchsorted(bounds, start, "right")
    # a word ends at the next sign between words or at the next text
    after = np.append(out, len(data))[np.searchsorted(out, start)]
    end = np.minimum(after, np.append(bounds, len(data))[text])
    stops = np.flatnonzero(_STOP[low])
    return Words(low, hashes, start, end, np.searchsorted(stops, start) + text)


def texts_of(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(lo, hi, words) of runs of texts of about RUN_BYTES, a longer text by itself."""
    data, offsets = _text.buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _text.RUN_BYTES, "right")) - 1)
        own = data[offsets[lo] : offsets[hi]]
        yield lo, hi, _words(own, offsets[lo:hi] - offsets[lo]) if len(own) <= 2 * _text.RUN_BYTES else _long(own)
        lo = hi


def _long(data: np.ndarray) -> Words:
    """Words of one long text, found part by part, cut between words."""
    got, start, piece = [], 0, 0
    while start < len(data):
        end = min(len(data), start + _text.RUN_BYTES)
        while end < len(data):
            gap = np.flatnonzero(~_WORD[data[end : end + _text.RUN_BYTES]])
            end = min(len(data), end + (int(gap[0]) if len(gap) else _text.RUN_BYTES))
            if len(gap):
                break
        w = _words(data[start:end], np.zeros(1, np.int64))
        got.append((w.hash, w.start + start, w.end + start, w.piece + piece))
        piece += int(_STOP[data[start:end]].sum())
        start = end
    return Words(_text.FOLD[data], *(np.concatenate([g[k] for g in got]) for k in range(4)))


def phrases(w: Words, lang: np.ndarray, length: int, a: int, z: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the phrases of a length that begin at words a to z. lang: a hash for each word."""
    z = min(z, len(w.hash) - length + 1)
    if z <= a:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _text.windows(w.hash[a : z + length - 1], length) ^ lang[a:z]
    own = np.flatnonzero(w.piece[a:z] == w.piece[a + length - 1 : z + length - 1])
    return own + a, _text.mixed(h[own])


def _langs(column: pa.Array, of: np.ndarray) -> np.ndarray:
    """Hash of the language of each text, looked up for each word."""
    coded = column.dictionary_encode() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().dictionary_encode()
    own = np.array([xxhash.xxh64_intdigest(x) for x in coded.dictionary.to_pylist()] or [0], np.uint64)
    return own[coded.indices.to_numpy(zero_copy_only=False)][of]


def cells(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells of a hash in both rows of a sketch."""
    mask = np.uint64((1 << bits) - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(64 - bits)) & mask).astype(np.int64)


class Reached:
    """The cells of a sketch that reach the least count, as bits."""

    def __init__(self, rows: np.ndarray, bits: int):
        self.rows, self.bits = rows, bits

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for row, c in zip(self.rows, cells(h, self.bits)):
            out &= (row[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
        return out


def survivors(w: Words, lang: np.ndarray, lengths: range, a: int, z: int, sketches: list[Reached]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, first word, hash) of phrases that begin at words a to z and that no sketch given rules out. sketches: of words and pairs, then of longer ones."""
    pairs = None
    for n in lengths:
        at, h = phrases(w, lang, n, a, z)
        if sketches and n > 2:
            if pairs is None:  # pairs that begin at a to z and beyond, as a prefix sum
                p, g = phrases(w, lang, 2, a, z + lengths[-1])
                pairs = np.zeros(z - a + lengths[-1] + 1, np.int64)
                pairs[p[sketches[0].has(g)] - a + 1] = 1
                pairs = np.cumsum(pairs)
            good = pairs[at - a + n - 1] - pairs[at - a] == n - 1
            at, h = at[good], h[good]
            if len(sketches) > 1:
                good = sketches[1].has(h)
                at, h = at[good], h[good]
        elif sketches:
            good = sketches[0].has(h)
            at, h = at[good], h[good]
        yield n, at, h


def _runs(b: pa.RecordBatch) -> Iterator[tuple[int, Words, np.ndarray, np.ndarray, int, int]]:
    """(lo, words, text of each word, hash of its language, a, z): words a to z of a run are to be worked on."""
    for lo, hi, w in texts_of(b.column(1)):
        if hi - lo == 1:
            text = np.full(len(w.hash), lo)
        else:
            _, offsets = _text.buffers(b.column(1))
            text = lo + np.searchsorted(offsets[lo + 1 : hi] - offsets[lo], w.start, "right")
        lang = _langs(b.column(0), text)
        for a in range(0, len(w.hash), PART):
            yield lo, w, text, lang, a, min(len(w.hash), a + PART)


def sketch(docs: DataFrame, bits: int, lengths: range, least: int, sketches: list) -> Reached:
    """docs: (lang, text). Cells of the merged sketch of phrases of these lengths that reach least.
    A task fills one sketch; blocks of 2^18 cells are added up as they come, and bits of cells go to the driver: 2^(bits - 2) bytes."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(sketches)
    kind = np.uint8 if least < 256 else np.uint32
    top = np.iinfo(kind).max
    block = min(BLOCK, 1 << bits)

    def added(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.minimum(x, top - y) + y  # no overflow

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.zeros((2, 1 << bits), kind)
        for b in batches:
            for _, w, _, lang, a, z in _runs(b):
                for _, _, h in survivors(w, lang, lengths, a, z, sent.value):
                    for row, c in zip(rows, cells(h, bits)):
                        c, n = np.unique(c, return_counts=True)
                        row[c] = added(row[c], np.minimum(n, top).astype(kind))
        for k, part in enumerate(rows.reshape(-1, block)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int64()), "cells": pa.array([part.tobytes()], pa.binary())})
        del rows
        _text.trim()

    def merged(x: bytes, y: bytes) -> bytes:
        return added(np.frombuffer(x, kind), np.frombuffer(y, kind)).tobytes()

    cores = spark.sparkContext.defaultParallelism
    parts = docs.mapInArrow(run, "block long, cells binary").rdd.map(lambda r: (r[0], bytes(r[1]))).reduceByKey(merged, cores)
    out = np.zeros((2 << bits) // 8, np.uint8)
    for k, packed in parts.mapValues(lambda x: np.packbits(np.frombuffer(x, kind) >= least).tobytes()).collect():
        out[k * block // 8 : (k + 1) * block // 8] = np.frombuffer(packed, np.uint8)
    return Reached(out.reshape(2, -1), bits)


def counts(docs: DataFrame, sketches: list[Reached], longest: int, least: int) -> DataFrame:
    """(lang, phrase, words, f) of phrases of one to ``longest`` words that occur ``least`` times or more, counted exactly;
    in a row of no phrase and 0 words, all words of a language."""
    sent = docs.sparkSession.sparkContext.broadcast(sketches)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        total: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            rows = list(held.values())
            held.clear()
            return pa.RecordBatch.from_pydict({"lang": pa.array([r[1] for r in rows], pa.string()), "phrase": pa.array([r[2] for r in rows], pa.binary()).cast(pa.string()), "words": pa.array([r[3] for r in rows], pa.int32()), "n": pa.array([r[0] for r in rows], pa.int64())})

        for b in batches:
            names = b.column(0).to_pylist()
            for lo, w, text, lang, a, z in _runs(b):
                for k, n in enumerate(np.bincount(text[a:z] - lo).tolist(), lo):
                    total[names[k]] = total.get(names[k], 0) + n
                for length, at, h in survivors(w, lang, range(1, longest + 1), a, z, sent.value):
                    h, first, n = np.unique(h, return_index=True, return_counts=True)
                    for key, i, m in zip(h.tolist(), at[first].tolist(), n.tolist()):
                        if (own := held.get(key)) is not None:
                            own[0] += m
                        else:
                            s, e = w.start[i : i + length].tolist(), w.end[i : i + length].tolist()
                            held[key] = [m, names[text[i]], b" ".join(w.data[x:y].tobytes() for x, y in zip(s, e)), length]
                if len(held) > HELD:
                    yield out()
        yield out()
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(total), pa.string()), "phrase": pa.nulls(len(total), pa.string()), "words": pa.array([0] * len(total), pa.int32()), "n": pa.array(list(total.values()), pa.int64())})
        _text.trim()

    found = docs.mapInArrow(run, "lang string, phrase string, words int, n long")
    return found.groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.sum("n").alias("f")).where((F.col("words") == 0) | (F.col("f") >= least))


def scored(found: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates among found, made by counts(), that no longer one subsumes."""
    total = found.where("words = 0").select("lang", F.col("f").alias("n"))
    split = F.split("phrase", " ")
    cand = found.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), split.alias("w"), "words")
    cut = cand.select("lang", "phrase", "a", "w", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("_l"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("_r"))
    part = lambda c, v: found.select("lang", F.col("phrase").alias(c), F.col("f").alias(v))
    cut = cut.join(part("_l", "l"), ["lang", "_l"]).join(part("_r", "r"), ["lang", "_r"]).join(total, "lang")
    score = F.expr("cast(a as decimal(16,0)) * cast(n as decimal(18,0)) * cast(1000 as decimal(4,0)) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b")
    best = cut.groupBy("lang", "phrase", "a", "n").agg(best)
    inner = lambda a, n: F.array_join(F.slice("w", F.lit(a), n), " ")
    longer = cand.where("words > 2").select("lang", "a", F.explode(F.array(inner(1, F.col("words") - 1), inner(2, F.col("words") - 1))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("_most"))
    best = best.join(longer, ["lang", "phrase"], "left").where(F.col("_most").isNull() | (100 * F.col("_most") < percent * F.col("a")))
    return best.select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))


def top(made: DataFrame, size: int = TOP) -> DataFrame:
    """The first rows of each language with their rank; first of 64 parts of it, so that no task sees all its phrases."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = made.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= size)
    out = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= size)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, percent: int = PERCENT, size: int = TOP, bits: int | None = None) -> DataFrame:
    """The first ``size`` collocations of each language: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    bounded(spark)
    own = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    letters = own.select(F.sum(F.octet_length("text"))).first()[0] or 0
    own = own.coalesce(max(spark.sparkContext.defaultParallelism, letters // TASK_BYTES))  # what a task counts is added up before the shuffle
    if bits is None:
        bits = min(MAX_BITS, max(LEAST_BITS, (letters // SPREAD).bit_length()))
    sketches = [sketch(own, bits, range(1, 3), least, [])]
    sketches.append(sketch(own, bits, range(3, longest + 1), least, sketches))
    found = stored(counts(own, sketches, longest, least), "phrases")
    return top(scored(found, percent), size)


def query(spark, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/documents.parquet"))
