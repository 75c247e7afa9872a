"""Language identification by rank-order profiles.

``profiles`` ranks the letter n-grams of all training texts of a language; ``predict`` ranks those of each text and
takes the language whose profile is nearest by out-of-place distance: the sum, over the text's most frequent n-grams,
of how far the rank in the profile is from the rank in the text, or ``size`` where the profile lacks the n-gram.

An n-gram is one to three signs of a lower-cased word between blanks (letters and the marks on them; whatever else is
between words), packed into one integer, so that different n-grams never meet. Counts are summed within a task before
the shuffle, and a language's ranks are taken from the first ``size`` of each task, so that no task sees all of them.
Texts of any length are read in parts.

Defined results: a null text, an empty one or one without a letter is ``und`` with score 0, and so is any text where
nothing was learned; a null id counts as held out and is never learned from; ties go to the smaller n-gram and to the
language first in order; repeated rows are judged one by one; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm._store import bounded
from strandloom.llm._text import trim

#: N-grams of a profile, and of a text that are compared with it.
SIZE = 400
LONGEST = 3
#: Profiles are sent to all tasks: at most so many languages (52 MB); ISO 639-3 names fewer.
MAX_LANGUAGES = 8192
#: Signs of a text that are worked on at a time, and n-grams that a task holds before it hands them on.
PART = 1 << 20
HELD = 1 << 18
_SIGN = 21  # bits of a sign


@cache
def _kinds() -> np.ndarray:
    """By code point: 2 a letter, 1 a mark on one, 0 others."""
    return np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(k))[0], 0) for k in range(0x110000)], np.uint8)


def signs(text: str | None) -> tuple[np.ndarray, bool]:
    """Code points of lower-cased words between single zeros, and whether there is a letter."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[code]
    code = np.concatenate([np.zeros(1, np.uint32), np.where(kind > 0, code, 0), np.zeros(1, np.uint32)])
    return code[np.append(True, (code[1:] > 0) | (code[:-1] > 0))], bool((kind == 2).any())


def counted(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, sorted, and their counts."""
    grams, counts = [], []
    for a in range(0, len(code), PART):
        own = code[a : a + PART + LONGEST - 1].astype(np.int64)
        found, g = [], own
        for n in range(1, LONGEST + 1):
            if n > 1:
                g = (g[:-1] << _SIGN) | own[n - 1 :]
            starts = min(PART, len(g))
            good = np.ones(starts, bool)
            for k in range(1 if n > 1 else 0, max(1, n - 1)):  # a blank only at the ends, and not alone
                good &= own[k : k + starts] > 0
            if n == 2:
                good &= (own[:starts] > 0) | (own[1 : 1 + starts] > 0)
            # packed with its length, which tells "_a" from "a"
            found.append(g[:starts][good] if n == LONGEST else g[:starts][good] - (1 << (62 + n - LONGEST + 1)))
        x, c = np.unique(np.concatenate(found), return_counts=True)
        grams.append(x)
        counts.append(c)
    if len(grams) == 1:
        return grams[0], counts[0]
    x, back = np.unique(np.concatenate(grams or [np.zeros(0, np.int64)]), return_inverse=True)
    return x, np.bincount(back, np.concatenate(counts or [np.zeros(0)]), len(x)).astype(np.int64)


def ranked(grams: np.ndarray, counts: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The first n-grams by count, ties by n-gram."""
    return grams[np.argsort(-counts, kind="stable")[:size]]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = SIZE) -> DataFrame:
    """(lang, gram, n, rank): the first ``size`` n-grams of every language of docs, counted over all its texts; rank from 0."""
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, int]] = {}

        def out() -> pa.RecordBatch:
            of = [(name, g, n) for name, own in held.items() for g, n in own.items()]
            held.clear()
            return pa.RecordBatch.from_pydict({"lang": [x[0] for x in of], "gram": pa.array([x[1] for x in of], pa.int64()), "n": pa.array([x[2] for x in of], pa.int64())})

        for b in batches:
            by: dict[str, list] = {}
            for name, value in zip(b.column(0).to_pylist(), b.column(1)):
                x, c = counted(signs(value.as_py())[0])
                by.setdefault(name, []).append((x, c))
            for name, parts in by.items():
                x, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                c = np.bincount(back, np.concatenate([p[1] for p in parts]), len(x)).astype(np.int64)
                own = held.setdefault(name, {})
                for g, n in zip(x.tolist(), c.tolist()):
                    own[g] = own.get(g, 0) + n
            if sum(map(len, held.values())) > HELD:
                yield out()
        yield out()
        trim()

    made = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = made.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", place - 1).where(F.col("rank") < size)


class Profiles:
    """Profiles as arrays: postings (language, rank) by n-gram."""

    def __init__(self, rows: pd.DataFrame, size: int = SIZE):
        self.names, self.size = sorted(rows["lang"].unique()), size
        rows = rows.sort_values(["gram", "lang"])
        self.grams, first = np.unique(rows["gram"].to_numpy(np.int64), return_index=True)
        self.first = np.append(first, len(rows))
        self.lang = np.searchsorted(np.array(self.names, object), rows["lang"].to_numpy(object)).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
        self.rank = rows["rank"].to_numpy(np.int64)

    def distances(self, grams: np.ndarray) -> np.ndarray:
        """Out-of-place distance of ranked n-grams to each language."""
        at = np.searchsorted(self.grams, grams)
        at[at == len(self.grams)] = 0
        own = np.flatnonzero(self.grams[at] == grams)
        n = (self.first[1:] - self.first[:-1])[at[own]]
        place = np.repeat(self.first[at[own]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum())) if len(own) else np.zeros(0, np.int64)
        near = self.size - np.abs(self.rank[place] - np.repeat(own, n))
        return len(grams) * self.size - np.bincount(self.lang[place], near, len(self.names)).astype(np.int64)


def predict(docs: DataFrame, learned: DataFrame, text: str = "text", keep: list[str] | None = None, size: int = SIZE) -> DataFrame:
    """The kept columns with ``lang_pred`` and ``score``: 1 less the nearest distance in parts of the largest possible one."""
    spark = docs.sparkSession
    bounded(spark)
    n = learned.select("lang").distinct().count()
    if n > MAX_LANGUAGES:
        raise ValueError(f"{n} languages; profiles of at most {MAX_LANGUAGES} are sent to tasks")
    model = Profiles(learned.select("lang", "gram", "rank").toPandas(), size)
    sent = spark.sparkContext.broadcast(model)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "lang_pred string, score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            names, scores = [], []
            for value in b.column(b.num_columns - 1):
                code, letters = signs(value.as_py())
                grams = ranked(*counted(code), model.size) if letters and model.names else np.zeros(0, np.int64)
                if len(grams):
                    d = model.distances(grams)
                    k = int(d.argmin())
                    names.append(model.names[k])
                    scores.append(1 - float(d[k]) / (len(grams) * model.size))
                else:
                    names.append("und")
                    scores.append(0.0)
            yield from pa.table([*b.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"]).to_batches()
        trim()

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("_text")).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    return predict(docs, profiles(docs.where("NOT held_out")), keep=["doc_id", "held_out"])
