"""Benchmark decontamination over a positional inverted index of the training text.

``build_index`` cuts the documents into segments of about ``SEGMENT_WORDS`` words (a longer
document is a segment of its own) and stores, for each segment and term, its postings: the
places of the term, as document ordinal << POS_BITS | position. A segment holds whole documents, so a
phrase is answered inside one segment and no postings of different segments ever meet.
``search`` sends the benchmark's windows to every segment. Terms are tried from the rarest of the
segment: its postings, moved back by the term's offset in the window, are the candidate starts,
and each further term's list is intersected at its own offset. What survives is an exact phrase. A proximity match is
a place of the window's first word that has each other word within ``slop`` words, in any order; its candidates lie about the rarest term's places.

The benchmark is a stated query set: it is sent in blocks of at most ``BLOCK_WINDOWS`` windows.

Defined results: null or empty texts have no words and no hits; an item without words has no
window; the words of an item without an id are hit, but it is no item that is counted or named; repeated document rows are each reported; repeated items (same id) count once; an empty
benchmark leaves all documents clean; clashing extra columns are ignored by the report.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import _text
from strandloom.llm._store import dropped, released, stored

WINDOW = 8
SLOP = 16
SEGMENT_WORDS = 1 << 20
BLOCK_WINDOWS = 1 << 18
#: Bits of a posting that hold the position; the rest hold the document's ordinal in its segment.
POS_BITS = 32

#: The row with is_docs has the segment's documents, each other row a term.
INDEX = "segment long, is_docs boolean, term long, places array<long>, doc_ids array<long>, n_words array<long>"


def _segment(number: int, docs: list, words: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row a term, ordered by term, and one row with the documents."""
    length = np.array([len(w) for w in words], np.int64)
    term = np.concatenate(words) if words else np.zeros(0, np.uint64)
    place = np.repeat(np.arange(len(words), dtype=np.int64) << POS_BITS, length) + np.concatenate([np.arange(n) for n in length] or [np.zeros(0, np.int64)])
    order = np.argsort(term, kind="stable")
    term, place = term[order].view(np.int64), place[order]
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    n = len(first)
    ends = np.append(first, len(term)).astype(np.int32)
    # n terms, then the row of the documents
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n + 1, number, np.int64)),
            pa.array(np.append(np.zeros(n, bool), True)),
            pa.array(np.append(term[first], 0)),
            pa.ListArray.from_arrays(pa.array(np.append(ends, len(term)).astype(np.int32)), pa.array(place)),
            pa.ListArray.from_arrays(pa.array(np.append(np.zeros(n + 1), len(docs)).astype(np.int32)), pa.array(docs, pa.int64())),
            pa.ListArray.from_arrays(pa.array(np.append(np.zeros(n + 1), len(docs)).astype(np.int32)), pa.array(length)),
        ],
        names=["segment", "is_docs", "term", "places", "doc_ids", "n_words"],
    )


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        docs, words, held = [], [], 0
        for b in batches:
            ids = b.column(0).to_pylist()
            for r in _text.runs(b.column(1), _text.ALNUM):
                for k in range(r.hi - r.lo):
                    own = r.words[r.first[k] : r.first[k + 1]]
                    if held and held + len(own) > segment_words:
                        yield from _segment(number, docs, words)
                        number, docs, words, held = number + 1, [], [], 0
                    docs.append(ids[r.lo + k])
                    words.append(own.copy())
                    held += len(own)
        if docs:
            yield from _segment(number, docs, words)

    return docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`").cast("string")).mapInArrow(run, INDEX)


def _blocks(benchmark: DataFrame, item_id: str, text: str, size: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list]]:
    """The query set in blocks, of which the driver holds one at a time: windows (rows of term hashes), their lengths, their items."""
    wins, lens, owner, names, held = [], [], [], [], 0
    it = benchmark.select(F.col(f"`{item_id}`").cast("string"), F.col(f"`{text}`").cast("string")).where(F.col(f"`{text}`").isNotNull()).distinct().toLocalIterator()
    for name, value in it:
        for r in _text.runs(pa.array([value]), _text.ALNUM):
            w = r.words
            if not len(w):
                continue
            n = min(size, len(w))
            own = np.zeros((len(w) - n + 1, size), np.uint64)
            own[:, :n] = np.lib.stride_tricks.sliding_window_view(w, n)
            wins.append(own)
            lens.append(np.full(len(own), n))
            owner.append(np.full(len(own), len(names)))
            names.append(name)
            held += len(own)
            if held >= limit:
                yield np.concatenate(wins), np.concatenate(lens), np.concatenate(owner), names
                wins, lens, owner, names, held = [], [], [], [], 0
    if wins:
        yield np.concatenate(wins), np.concatenate(lens), np.concatenate(owner), names


def _find(terms: np.ndarray, ends: np.ndarray, places: np.ndarray, wins: np.ndarray, lens: np.ndarray, slop: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(window, place) of each match in a segment. terms: sorted; places[ends[t]:ends[t+1]] are the postings of term t, sorted.
    slop None: exact phrases, place is the start; else places of the window's first word that have all others within slop words."""
    size = wins.shape[1]
    used = np.arange(size)[None, :] < lens[:, None]
    at = np.searchsorted(terms, wins.view(np.int64))
    at[at == len(terms)] = 0
    there = (terms[at] == wins.view(np.int64)) | ~used
    alive = np.flatnonzero(there.all(axis=1)) if len(terms) else np.zeros(0, np.int64)
    none = np.zeros(0, np.int64)
    if not len(alive):
        return none, none
    at, used = at[alive], used[alive]
    count = np.where(used, (ends[1:] - ends[:-1])[at], np.iinfo(np.int64).max)
    order = np.argsort(count, axis=1, kind="stable")
    rare = order[:, 0]
    first, n = ends[at[np.arange(len(alive)), rare]], count[np.arange(len(alive)), rare]
    found_w, found_p = [], []
    # windows in runs of a bounded number of candidates
    cut = np.searchsorted(np.cumsum(n), np.arange(1, int(n.sum()) // 4_000_000 + 1) * 4_000_000)
    for part in np.split(np.arange(len(alive)), np.unique(cut)):
        if not len(part):
            continue
        w = np.repeat(part, n[part])
        p = places[np.repeat(first[part] - np.concatenate([[0], np.cumsum(n[part])[:-1]]), n[part]) + np.arange(int(n[part].sum()))]
        if slop is None:
            good = (p & ((1 << POS_BITS) - 1)) >= rare[w]
            w, begin = w[good], (p - rare[w])[good]
        else:  # the first word's places about those of the rarest, each once
            lo, hi = ends[at[w, 0]], ends[at[w, 0] + 1]
            a = _lower_bound(places, lo, hi, p - np.minimum(slop, p & ((1 << POS_BITS) - 1)))
            z = _lower_bound(places, a, hi, p + slop + 1)
            w, n_near = np.repeat(w, z - a), z - a
            begin = places[np.repeat(a - np.concatenate([[0], np.cumsum(n_near)[:-1]]), n_near) + np.arange(int(n_near.sum()))]
            w, begin = np.unique(np.stack([w, begin]), axis=1)
        for k in range(0 if slop is not None else 1, size):
            if not len(w):
                break
            j = order[w, k]
            live = used[w, j]
            t = at[w, j]
            lo, hi = ends[t], ends[t + 1]
            want = begin + j if slop is None else begin - np.minimum(slop, begin & ((1 << POS_BITS) - 1))
            place = _lower_bound(places, lo, hi, want)
            ok = place < hi
            got = places[np.where(ok, place, 0)]
            ok &= (got == want) if slop is None else ((got <= begin + slop) & (got >> POS_BITS == begin >> POS_BITS))
            good = ok | ~live
            w, begin = w[good], begin[good]
        found_w.append(w)
        found_p.append(begin)
    return alive[np.concatenate(found_w)], np.concatenate(found_p)


def _lower_bound(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray) -> np.ndarray:
    """First place in values[lo:hi], each range sorted, whose value is at least want."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        less = open_ & (values[np.where(open_, mid, 0)] < want)
        lo = np.where(less, mid + 1, lo)
        hi = np.where(open_ & ~less, mid, hi)
    return lo


FOUND = "segment long, nth int, doc_id long, n_words long, starts array<long>, ends array<long>, whole boolean, items array<string>, near_items array<string>"


def _searched(index: DataFrame, block, slop: int | None, every: bool) -> DataFrame:
    """FOUND for one block of the query set; only documents with a match, or every one."""
    sent = index.sparkSession.sparkContext.broadcast(block)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        info = part[part.is_docs].iloc[0]
        rows = part[~part.is_docs].sort_values("term")
        doc_ids, n_words = list(info.doc_ids), np.array(info.n_words, np.int64)
        found = [(set(), set()) for _ in doc_ids]
        starts, ends_, whole = [[] for _ in doc_ids], [[] for _ in doc_ids], np.zeros(len(doc_ids), bool)
        if len(rows):
            terms = rows.term.to_numpy(np.int64)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in rows.places])]).astype(np.int64)
            places = np.concatenate([np.asarray(x, np.int64) for x in rows.places])
            wins, lens, owner, names = sent.value
            for kind, s in enumerate((None,) if slop is None else (None, slop)):
                w, p = _find(terms, ends, places, wins, lens, s)
                doc = p >> POS_BITS
                for d, i in set(zip(doc.tolist(), owner[w].tolist())):
                    if names[i] is not None:
                        found[d][kind].add(names[i])
                if s is None:
                    whole[doc[lens[w] == wins.shape[1]]] = True
                    at = p & ((1 << POS_BITS) - 1)
                    for d, x, y in zip(doc.tolist(), at.tolist(), (at + lens[w]).tolist()):
                        starts[d].append(x)
                        ends_[d].append(y)
        lists = lambda x: pd.Series(list(x), dtype=object)
        pick = [k for k in range(len(doc_ids)) if every or starts[k] or found[k][1]]
        return pd.DataFrame({
            "segment": np.full(len(pick), key[0]), "nth": np.array(pick, np.int32), "doc_id": pd.array([doc_ids[k] for k in pick], "Int64"), "n_words": n_words[pick],
            "starts": lists(starts[k] for k in pick), "ends": lists(ends_[k] for k in pick), "whole": whole[pick],
            "items": lists(sorted(found[k][0]) for k in pick), "near_items": lists(sorted(found[k][1]) for k in pick),
        })

    asked = np.unique(block[0].view(np.int64)).tolist()  # only the postings that the block asks for leave the index
    terms = index.sparkSession.createDataFrame([(t, True) for t in asked], "term long, _asked boolean")
    index = index.join(F.broadcast(terms), "term", "left").where("is_docs or _asked").drop("_asked")
    return index.groupBy("segment").applyInPandas(run, FOUND)


def _covered(starts: list, ends: list) -> int:
    """Positions inside any of the spans."""
    if not len(starts):
        return 0
    a, z = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
    o = np.argsort(a, kind="stable")
    a, z = a[o], z[o]
    reach = np.concatenate([[0], np.maximum.accumulate(z)[:-1]])  # each span adds what lies beyond all before it
    return int(np.maximum(0, z - np.maximum(a, reach)).sum())


def search(index: DataFrame, benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW, slop: int | None = SLOP, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row a document row of the index: doc_id, n_words, n_hit, whole (a window of full size occurs), items (sorted strings with exact phrases), near_items.
    Blocks are searched one after another, each stored where there are several."""
    spark, parts, blocks = index.sparkSession, [], _blocks(benchmark, item_id, text, size, block_windows)
    none = (np.zeros((0, size), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), [])
    block = next(blocks, none)
    while block is not None:
        after = next(blocks, None)
        part = _searched(index, block, slop, every=not parts)
        parts.append(part if after is None and not parts else stored(part, "found"))
        block = after

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = [_covered(x, y) for x, y in zip(b.column("starts").to_pylist(), b.column("ends").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(hit, pa.int64()), *(b.column(c) for c in ("whole", "items", "near_items"))], names=["doc_id", "n_words", "n_hit", "whole", "items", "near_items"])

    out = parts[0]
    if len(parts) > 1:
        lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends")] + [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near_items")]
        out = reduce(DataFrame.unionByName, parts).groupBy("segment", "nth").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.max("whole").alias("whole"), *lists)
    return out.mapInArrow(merged, "doc_id long, n_words long, n_hit long, whole boolean, items array<string>, near_items array<string>")


def report(found: DataFrame, least_items: int = 2) -> DataFrame:
    """The exact matches in figures, and the items with proximity matches."""
    n = F.size("items").cast("long")
    return found.select(
        "doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n >= least_items).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"), F.sha2(F.array_join("near_items", ","), 256).alias("near_items_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    index = stored(build_index(spark.read.parquet(f"{sf_dir}/documents.parquet")), "postings")
    return report(search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that hold a window of ``WINDOW`` words of a benchmark item, or windows of two items or more (items of fewer words
    are one window, and one of them alone is no evidence). Rows of one id share their fate."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    index = stored(build_index(docs), "postings")
    bad = stored(search(index, bench, slop=None).where(F.col("whole") | (F.size("items") >= 2)).select(F.col("doc_id").alias("_bad")).distinct(), "bad")
    dropped(spark, index)
    released(spark)
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]), "left_anti")


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
