"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit
a rule; a policy is a named, versioned set of bits, so changing it never reads a text again.
Ablations are sums over the distinct bit patterns, of which there are at most 2^rules.

Defined results: a null or empty text has no words and fails ``few_words``; repeated rows are
judged one by one; an empty table gives an empty ledger; a document's row is kept whatever its
other columns hold, and the ledger's own names replace clashing ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm import _text
from strandloom.llm._store import bounded

SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")

#: name, failure as SQL over the measurements; a rule's bit is its place here, so append only.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 20 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("capitals", "100 * n_upper > 60 * n_letters"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
POLICIES = {
    "base-1": BASE,
    "web-1": BASE | BIT["symbols"] | BIT["duplicate_lines"],
    "web-2": sum(BIT.values()),
}
CURRENT = "web-2"


def _measure(texts: pa.Array) -> pa.Table:
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    rows = {k: [] for k in MEASURES}
    for run in _text.runs(texts, _text.NOT_SPACE, _text.PLAIN):
        n = run.hi - run.lo
        inside = _text.NOT_SPACE[run.data]
        ascii_upper, ascii_lower = (run.data >= 65) & (run.data <= 90), (run.data >= 97) & (run.data <= 122)
        win, owner = _text.windows(run.words, 3), _text.owners(run.first)
        covered = np.zeros(len(run.words), bool)
        if len(win):
            own = owner[: len(win)] == owner[2:]
            place = np.flatnonzero(own)
            _, back, count = np.unique(_text.mixed(win[place] + owner[place].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
            found = place[count[back] > 1]
            for k in range(3):
                covered[found + k] = True
        lines = np.zeros((2, n), np.int64)
        for k in range(n):
            held = [x for x in run.data[run.offsets[k] : run.offsets[k + 1]].tobytes().split(b"\n") if x.strip(b" \t\v\f\r")]
            lines[:, k] = len(held), len(held) - len(set(held))
        for name, value in (
            ("n_words", np.diff(run.first)),
            ("word_chars", _text.per_text(inside & ((run.data & 0xC0) != 0x80), run.offsets)),
            ("n_symbols", _text.per_text(symbol[run.data], run.offsets)),
            ("n_dup_lines", lines[1]),
            ("n_repeat_words", np.bincount(owner, covered, n).astype(np.int64)),
            ("n_lines", lines[0]),
            ("n_upper", _text.per_text(ascii_upper, run.offsets)),
            ("n_letters", _text.per_text(ascii_upper | ascii_lower, run.offsets)),
        ):
            rows[name].append(value)
    return pa.table({k: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for k, v in rows.items()})


def ledger(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns, the measurements and ``fail_bits`` (long) of every row."""
    bounded(docs.sparkSession)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in (*MEASURES, "fail_bits")]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(m, T.LongType()) for m in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = _measure(b.column(b.num_columns - 1))
            yield from pa.table([b.column(k) for k in range(len(kept))] + t.columns, names=[*kept, *MEASURES]).to_batches()

    out = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("_text")).mapInArrow(run, schema)
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, rule) in enumerate(RULES)]
    return out.withColumn("fail_bits", reduce(lambda a, b: a.bitwiseOR(b), bits))


def failed(policy: str | int = CURRENT) -> Column:
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    return F.col("fail_bits").bitwiseAND(F.lit(mask)) != 0


def ablation(made: DataFrame, policy: str = CURRENT) -> DataFrame:
    """By rule of the policy: rows that fail it, and rows that only it rejects. One shuffle of bit patterns."""
    mask = POLICIES[policy]
    seen = made.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rule = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(b).cast("long").alias("bit")) for name, b in BIT.items() if b & mask]))
    return (
        seen.select("bits", "n", rule.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        )
    )


def query(spark, sf_dir: str) -> DataFrame:
    made = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    return made.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed(BASE).alias("base_failed"), (~failed(BASE) & ~failed()).alias("kept"), "fail_bits",
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the policy keeps, with their own columns, whatever their names."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    return ledger(whole, keep=["row"]).where(~failed()).select("row.*")
