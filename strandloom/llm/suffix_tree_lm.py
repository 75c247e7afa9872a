"""A probabilistic suffix tree over words, trained on all training documents and used to score all documents.

Tree. The root is the smoothed unigram distribution. A context of 1 to ``DEPTH`` words may be a node, and a next symbol may be
stored at it, when the n-gram occurs at least ``LEAST`` times, at any size of the corpus. A symbol is stored where
its probability differs from the parent's by a factor of ``RATIO``; the node is kept when the stored symbols' divergence
from the parent (counts times log ratio, in nats) reaches ``GAIN``, or a longer kept context ends in it. With C the
context's count, S the stored symbols' and B = C - S + 1:
p(t | s) = (count(s t) + B p(t | parent)) / (C + 1), which sums to one. A text is scored with the longest
kept suffix of each token's history.

Scale. Counts and nodes are tables that grow with the input. A text's score is a sum over its n-grams: log p of each token at the root,
log(B / (C + 1)) of each kept context that a token follows, and for each stored symbol what its own entry adds to that. So
``weights`` gives each n-gram one number and scoring is a join on the n-gram. Counts and lookups are shuffled by buckets of hashed keys, whose
number grows with the input, as packed arrays, so that a task holds one bucket's keys at a time. Lookups go in ``PASSES`` rounds over the buckets, whose
shuffles are dropped one by one, so that the disk holds a part of them at a time. What they find goes back packed to the block of texts that asked. Keys above a share of ``HEAD`` (at most 1 / HEAD
an order) are looked up in a broadcast, since they would be hot in a shuffle, all others by a shuffle. A
bitmap of fixed size leaves out keys that have no row, which loses none.

Defined results: a null or empty text is the end token alone; a null id is training text; repeated
rows are scored one by one and all count for training; without training text every token has the probability
0.5 / 0.5; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import _text
from strandloom.llm._bits import bitmap, marked
from strandloom.llm._store import dropped, released, stored

DEPTH = 3
RATIO = 1.1
GAIN = 6.0
LEAST = 3
HEAD = 1e-6
END = np.uint64(0x1D8E4E27C47D124F)
HELD = 1 << 18  # distinct keys that a task counts before it passes them on
BUCKET = 1 << 18  # keys of a bucket, about
BLOCK = 2000  # texts whose lookups are sent together, at most
PASSES = 4  # rounds of lookups, a power of two up to 8; each shuffles the keys of its buckets alone


def tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, tokens of a run of texts with the end token after each, where each text begins)."""
    for r in _text.runs(column):
        n = r.hi - r.lo
        ends = r.first[1:] + np.arange(n)
        out = np.empty(len(r.words) + n, np.uint64)
        mask = np.ones(len(out), bool)
        mask[ends] = False
        out[mask] = r.words
        out[ends] = END
        yield r.lo, out, np.concatenate([[0], ends + 1])


class Counter:
    """Counts of n-grams by key, with what identifies each, handed on when there are many."""

    def __init__(self, names: list[str]):
        self.names, self.rows, self.counts = names, np.zeros((len(names), 0), np.int64), np.zeros(0, np.int64)
        self.loose, self.n = [], 0

    def add(self, rows: np.ndarray) -> pa.RecordBatch | None:
        """rows: one for each name, the first of which is the key."""
        self.loose.append(rows)
        self.n += rows.shape[1]
        if self.n < HELD:
            return None
        self._merge()
        return self.flush() if len(self.counts) >= 2 * HELD else None

    def _merge(self) -> None:
        rows = np.concatenate([self.rows, *self.loose], axis=1)
        counts = np.concatenate([self.counts, np.ones(self.n, np.int64)])
        order = np.argsort(rows[0], kind="stable")
        key = rows[0][order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.rows, self.counts = rows[:, order[new]], np.add.reduceat(counts[order], new) if len(new) else counts
        self.loose, self.n = [], 0

    def flush(self) -> pa.RecordBatch | None:
        if self.n:
            self._merge()
        out = pa.RecordBatch.from_arrays([*map(pa.array, self.rows), pa.array(self.counts)], names=[*self.names, "n"]) if len(self.counts) else None
        self.rows, self.counts = self.rows[:, :0], self.counts[:0]
        return out


class Places:
    """Places of keys among sorted distinct ones, by the leading bits of their hashes."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.view(np.uint64)
        self.shift = np.uint64(64 - max(1, len(keys).bit_length()))
        at = (self.keys >> self.shift).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=1 << int(64 - int(self.shift))))])

    def of(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each, or -1."""
        wanted = wanted.view(np.uint64)
        at = (wanted >> self.shift).astype(np.int64)
        out, lo, hi = np.full(len(wanted), -1, np.int64), self.starts[at], self.starts[at + 1]
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            here = lo[open_]
            same = self.keys[here] == wanted[open_]
            out[open_[same]] = here[same]
            open_ = open_[~same]
            lo[open_] += 1
            open_ = open_[lo[open_] < hi[open_]]
        return out


def counted(docs: DataFrame, make) -> DataFrame:
    """(key, n) over the keys that make(tokens, first) gives for training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Counter(["key"])
        for b in batches:
            for _, t, first in tokens(b.column(0)):
                if out := c.add(make(t, first)):
                    yield out
        if out := c.flush():
            yield out

    return docs.where("not _held").select("_text").mapInArrow(run, "key long, n long").repartition("key").groupBy("key").agg(F.sum("n").alias("n"))


def buckets_for(rows: int) -> int:
    """A power of two, so that a bucket of hashed keys holds some BUCKET of so many rows."""
    return 1 << max(3, math.ceil(math.log2(max(1, rows) / BUCKET)))


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return (_text.mixed(keys.view(np.uint64)) >> np.uint64(64 - n.bit_length() + 1)).astype(np.int64)


def dealt(bucket: np.ndarray, side: int, columns: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each bucket, with its part of each column as bytes; rows of a bucket must lie together."""
    new = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(new[1:], len(bucket))
    parts = [pa.array([c[x:y].tobytes() for x, y in zip(new.tolist(), ends.tolist())], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(bucket[new]), pa.array(np.full(len(new), side)), *parts], names=["bucket", "side", *(f"c{k}" for k in range(len(columns)))])


def counted_grams(docs: DataFrame, make, order: int, least: int, tokens_in_all: int) -> DataFrame:
    """(key, ctx, short, n) of the n-grams of n >= least, from the rows key, ctx, short that make(tokens, first) gives. They are shuffled by bucket,
    packed; a pair of words without its key, which its words give."""
    many, pairs = buckets_for(tokens_in_all), order == 2

    def packed(c: pa.RecordBatch) -> pa.RecordBatch:
        key, ctx, short, n = (x.to_numpy() for x in c.columns)
        at = bucket_of(key, many)
        o = np.lexsort((ctx, at))
        return dealt(at[o], 0, [x[o] for x in ((ctx, short) if pairs else (ctx, short, key))] + [n[o].astype(np.uint32)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Counter(["key", "ctx", "short"])
        for b in batches:
            for _, t, first in tokens(b.column(0)):
                if out := c.add(make(t, first)):
                    yield packed(out)
        if out := c.flush():
            yield packed(out)

    def total(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        col = lambda k, t: np.concatenate([np.frombuffer(x.as_buffer(), t) for h in held for x in h.column(k)])
        ctx, short = col(2, np.int64), col(3, np.int64)
        key, n = pair_keys(ctx, short) if pairs else col(4, np.int64), col(-1, np.uint32).astype(np.int64)
        o = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.concatenate([[True], np.diff(key[o]) != 0]))
        n = np.add.reduceat(n[o], new)
        o, n = o[new][n >= least], n[n >= least]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key[o], ctx[o], short[o], n)], names=["key", "ctx", "short", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_bucket(batches):
            yield total(held)

    columns = ", ".join(f"c{k} binary" for k in range(3 if pairs else 4))
    sent = docs.where("not _held").select("_text").mapInArrow(run, f"bucket long, side long, {columns}")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, "key long, ctx long, short long, n long")


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each bucket, from batches in order of bucket."""
    held, at = [], None
    for b in batches:
        bucket = b.column(0).to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
        for x, y in zip(cut, np.append(cut[1:], len(bucket)).tolist() if len(bucket) else []):
            if bucket[x] != at and held:
                yield held
                held = []
            at = bucket[x]
            held.append(b.slice(x, y - x))
    if held:
        yield held


def gram_keys(t: np.ndarray, most: int) -> list[np.ndarray]:
    """Keys of the n-grams of 1 to ``most`` words that begin at each token; of one word, its own."""
    out = [t]
    for k in range(1, most):
        n = max(0, len(t) - k)
        out.append(pair_keys(out[-1][:n], t[k:]).view(np.uint64))
    return out


def begins(first: np.ndarray, order: int) -> np.ndarray:
    """Where n-grams of an order begin that lie inside one text."""
    text = _text.owners(first)
    return np.flatnonzero(text[: max(0, len(text) - order + 1)] == text[order - 1 :])


def looked_up(rows: DataFrame, column: str, table: DataFrame, how: str = "inner") -> DataFrame:
    """rows with the table's columns but key. Rows are distinct n-grams, so that a frequent context has at most as many as there are words; skewed ones are split by AQE."""
    return rows.join(table.withColumnRenamed("key", column), column, how)


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys of n-grams that are one word longer than those of keys a, by their last words b."""
    with np.errstate(over="ignore"):
        return _text.mixed(a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.view(np.uint64)).view(np.int64)


def frequent_grams(docs: DataFrame, unigrams: DataFrame, depth: int, least: int, tokens_in_all: int) -> list[DataFrame]:
    """(key, ctx, short, n) of n-grams of 2, 3, .. depth + 1 words, a table each; ctx: without the last word, short: without the first."""
    spark, out, bits = docs.sparkSession, [], bitmap(unigrams.where(F.col("n") >= least))
    for k in range(2, depth + 2):
        shorter = spark.sparkContext.broadcast(bits)

        def make(t: np.ndarray, first: np.ndarray, k=k, shorter=shorter) -> np.ndarray:
            """An n-gram is no more frequent than the two in it that are a word shorter."""
            *_, part, own = gram_keys(t, k)
            ok, at = marked(shorter.value, part), begins(first, k)
            at = at[ok[at] & ok[at + 1]]
            return np.stack([own[at], part[at], part[at + 1]]).view(np.int64)

        out.append(stored(counted_grams(docs, make, k, least, tokens_in_all), "grams"))
        shorter.unpersist()
        released(spark)
        bits = bitmap(out[-1]) if k <= depth else bits
    return out


def weights(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, head: float = HEAD) -> tuple[DataFrame, int, int, float, int]:
    """docs: (_held, _text). The table (key, n, lp, w), training tokens, distinct ones, the root's denominator, the count of a hot key.
    lp: log10 of the root's probability (null but for single tokens); w: what an occurrence of the n-gram adds to it."""
    unigrams = stored(counted(docs, lambda t, first: t.view(np.int64)[None, :]), "unigrams")
    n, v = unigrams.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, hot = n + 0.5 * (v + 1), max(2, math.ceil(head * n))
    spark, temporary, p = docs.sparkSession, [], (F.col("n") + 0.5) / F.lit(total)
    made = unigrams.select("key", "n", F.log10(p).alias("lp"), F.lit(0.0).alias("w"))
    if depth and n:
        grams, below = frequent_grams(docs, unigrams, depth, least, n), unigrams.withColumn("p", p)
        for d in range(1, depth + 1):
            rows = looked_up(grams[d - 1], "ctx", below.select("key", F.col("n").alias("c")))
            rows = looked_up(rows, "short", below.select("key", F.col("p").alias("parent")))
            own = F.col("n") / F.col("c")
            rows = rows.withColumn("apart", F.greatest(own / F.col("parent"), F.col("parent") / own) >= RATIO)
            rows = apart = stored(rows.withColumn("gain", F.when(F.col("apart"), F.col("n") * F.log(own / F.col("parent"))).otherwise(0.0)), "rows")
            nodes = rows.groupBy(F.col("ctx").alias("key")).agg(F.max("c").alias("n"), F.sum(F.when(F.col("apart"), F.col("n")).otherwise(0)).alias("s"), F.sum("gain").alias("gain"))
            nodes = stored(nodes.where(F.col("gain") >= GAIN).drop("gain"), "nodes")
            rows = looked_up(rows.drop("gain"), "ctx", nodes.drop("n"), "left")
            b = F.col("c") - F.col("s") + 1
            entry, back = (F.col("n") + b * F.col("parent")) / (F.col("c") + 1), b / (F.col("c") + 1)
            kept = F.col("s").isNotNull()
            rows = rows.select(
                "key", "n", F.when(kept & F.col("apart"), entry).when(kept, back * F.col("parent")).otherwise(F.col("parent")).alias("p"),
                F.when(kept & F.col("apart"), F.log10(entry) - F.log10(back * F.col("parent"))).alias("w"),
            )
            below = stored(rows, "probabilities")
            temporary += [below, nodes]
            for x in (grams[d - 1], apart):
                dropped(spark, x)
            released(spark)
            none = F.lit(None).cast("double").alias("lp")
            made = made.unionByName(below.where("w is not null").select("key", "n", none, "w"))
            made = made.unionByName(nodes.select("key", "n", none, F.log10((F.col("n") - F.col("s") + 1) / (F.col("n") + 1)).alias("w")))
    made = made.groupBy("key").agg(F.max("n").alias("n"), F.max("lp").alias("lp"), F.sum("w").alias("w"))
    out = stored(made, "weights")
    for x in (unigrams, *temporary):
        dropped(spark, x)
    return out, n, v, total, hot


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, least: int = LEAST, folds: int = 5, held_fold: int = 1, head: float = HEAD) -> DataFrame:
    name = F.col(f"`{doc_id}`").cast("long")
    held = F.coalesce(F.crc32(name.cast("string").cast("binary")) % folds == held_fold, F.lit(False))
    docs = docs.select(name.alias("_id"), held.alias("_held"), F.col(f"`{text}`").cast("string").alias("_text"))
    table, n, _, total, hot = weights(docs, depth, least, head)
    released(docs.sparkSession)
    top = table.where(F.col("n") >= hot).toPandas()  # at most 1 / head rows an order
    top = top.iloc[np.argsort(top.key.to_numpy(np.int64).view(np.uint64))]
    known = [top.key.to_numpy(np.int64).copy(), np.nan_to_num(top.lp.to_numpy(float)), top.w.to_numpy(float)]
    rest = table.where(F.col("n") < hot)
    sent = docs.sparkSession.sparkContext.broadcast((Places(known[0]), *known[1:], bitmap(rest)))
    unseen = math.log10(0.5 / total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        keys, lp, w, bits = sent.value
        for b in batches:
            for lo, t, first in tokens(b.column(2)):
                k = len(first) - 1
                text = _text.owners(first)
                at, grams = keys.of(t), gram_keys(t, depth + 1)
                there, far = at >= 0, (at < 0) & marked(bits, t)
                none = ~there & ~far  # surely not in training text
                base = np.where(far, 0.0, unseen)
                base[there] = lp[at[there]]
                model, asked, owner = base.copy(), [t[far].view(np.int64)], [text[far]]
                model[there] += w[at[there]]
                for order in range(2, depth + 2):
                    begin = begins(first, order)
                    g = grams[order - 1][begin]
                    at = keys.of(g)
                    there = at >= 0
                    model[begin[there]] += w[at[there]]
                    other = ~there & marked(bits, g)
                    asked.append(g[other].view(np.int64))
                    owner.append(text[begin[other]])
                asked, owner = np.concatenate(asked), np.concatenate(owner)
                asked = asked[np.argsort(owner, kind="stable")]
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=k))]).astype(np.int32)
                sums = [np.add.reduceat(x, first[:-1]) for x in (base, model, far.astype(np.int64), none.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + k)), b.column(0).slice(lo, k), b.column(1).slice(lo, k), pa.array(np.diff(first)), *map(pa.array, sums), pa.ListArray.from_arrays(pa.array(ends), pa.array(asked))],
                    names=["row", "doc_id", "held_out", "n_tokens", "base", "model", "far", "none", "asked"],
                )
                row += k

    made = stored(docs.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, base double, model double, far long, none long, asked array<long>"), "scored")
    released(docs.sparkSession)
    sent.unpersist()
    found = answered(made.select("row", "asked"), rest).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("lp", "w", "seen")])
    missed = F.col("far") - F.coalesce("seen", F.lit(0))
    lp = F.coalesce("lp", F.lit(0.0)) + missed * F.lit(unseen)
    return made.drop("asked").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_tokens") - F.col("none") - missed).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + lp).alias("base_score"), (F.col("model") + lp + F.coalesce("w", F.lit(0.0))).alias("score"),
    )


def blocks(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of numbered texts, each of at most BLOCK texts with numbers in turn: a batch may span files, whose tasks number apart."""
    row = b.column(0).to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(row) != 1) + 1).tolist(), len(b)]
    for lo, hi in zip(cuts, cuts[1:]):
        for x in range(lo, hi, BLOCK):
            yield b.slice(x, min(BLOCK, hi - x))


def summed(own: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Distinct texts and each column's sums, from texts in order."""
    new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    return [own[new], *(np.add.reduceat(c, new, dtype=c.dtype) if len(new) else c for c in columns)]


def answered(asked: DataFrame, table: DataFrame) -> DataFrame:
    """(row, lp, w, seen): sums over the asked keys of a text that the table (key, lp, w) has, in parts, one a round of lookups. A round has every
    PASSES-th bucket; its sums are stored and its shuffles dropped before the next."""
    many, parts = buckets_for(table.count()), []
    for nth in range(PASSES):
        parts.append(stored(_answered(asked, table, many, nth), "answers"))
        released(asked.sparkSession)
    return reduce(DataFrame.unionByName, parts)


def _answered(asked: DataFrame, table: DataFrame, many: int, nth: int) -> DataFrame:
    """The sums of one round, at most one row a text. Both sides are shuffled by bucket, packed; of each bucket, the table's part comes first and is held, those
    of the texts pass by. What is found goes back packed to the block that asked, a row a block and bucket with at most an entry a found key, and is summed there."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in blocks(b):
                key, n = part.column(1).flatten().to_numpy(), np.diff(part.column(1).offsets.to_numpy())
                if not len(key):
                    continue
                at, own = bucket_of(key, many), np.repeat(np.arange(len(part), dtype=np.uint16), n)
                now = np.flatnonzero(at % PASSES == nth)
                o = now[np.argsort(at[now], kind="stable")]
                if not len(o):
                    continue
                out = dealt(at[o], 1, [key[o], own[o]])
                block = pa.array([part.column(0)[0].as_py().to_bytes(8, "little")] * len(out), pa.binary())
                yield pa.RecordBatch.from_arrays([*out.columns, block], names=["bucket", "side", "c0", "c1", "c2"])

    def know(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, lp, w = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            at = bucket_of(key, many)
            now = np.flatnonzero(at % PASSES == nth)
            o = now[np.argsort(at[now], kind="stable")]
            yield dealt(at[o], 0, [key[o], lp[o].astype(float), w[o].astype(float)])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "token", "seen", "lp", "gram", "w"]
        out = lambda: pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if k == 0 else pa.binary()) for k, x in enumerate(zip(*found))], names=names)
        found, held, at, parts, known = [], 0, None, [], None
        for b in batches:
            for bucket, side, c0, c1, c2 in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), b.column(4)):
                if bucket != at:
                    at, parts, known = bucket, [], None
                if side == 0:
                    parts.append([np.frombuffer(c.as_buffer(), t) for c, t in ((c0, np.int64), (c1, float), (c2, float))])
                    continue
                if known is None:
                    x = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
                    o = np.argsort(x[0].view(np.uint64), kind="stable")
                    known, parts = [Places(x[0][o].copy()), x[1][o], x[2][o]], []
                place, own = known[0].of(np.frombuffer(c0.as_buffer(), np.int64)), np.frombuffer(c1.as_buffer(), np.uint16)
                there = place >= 0
                place, own = place[there], own[there]
                lp, w = known[1][place], known[2][place]
                token, gram = ~np.isnan(lp), w != 0  # a single token may have a context's weight too
                if len(own):
                    sums = (*summed(own[token], np.ones(token.sum(), np.uint32), lp[token]), *summed(own[gram], w[gram]))
                    found.append((int.from_bytes(c2.as_py(), "little", signed=True), *(x.tobytes() for x in sums)))
                held += len(own)
                if held >= HELD:
                    yield out()
                    found, held = [], 0
        if found:
            yield out()

    def total(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        types = (np.uint16, np.uint32, float, np.uint16, float)
        token, seen, lp, gram, w = (np.concatenate([np.frombuffer(x.as_buffer(), t) for h in held for x in h.column(k)]) for k, t in enumerate(types, 1))
        o = np.flatnonzero(np.bincount(token, minlength=BLOCK) + np.bincount(gram, minlength=BLOCK))
        lp, w, seen = (np.bincount(x, y, BLOCK)[o] for x, y in ((token, lp), (gram, w), (token, seen)))
        columns = [held[0].column(0)[0].as_py() + o, lp.astype(float), w.astype(float), seen.astype(np.int64)]  # bincount of nothing gives integers
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["row", "lp", "w", "seen"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_bucket(batches):
            yield total(held)

    schema = "bucket long, side long, c0 binary, c1 binary, c2 binary"
    both = table.select("key", "lp", "w").mapInArrow(know, schema).unionByName(asked.mapInArrow(ask, schema))
    found = both.repartition("bucket").sortWithinPartitions("bucket", "side").mapInArrow(answer, "block long, token binary, seen binary, lp binary, gram binary, w binary")
    return found.repartition("block").sortWithinPartitions("block").mapInArrow(add, "row long, lp double, w double, seen long")


def query(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
