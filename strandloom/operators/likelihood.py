"""Likelihoods of genotypes where errors of one strand depend on each other.

The bases of a column are taken by falling quality. The k-th of an allele on a strand counts by a factor that decays
with k, and the quality of the k-th of an allele, of n bases in all, is the log ratio of two tails of a binomial: the
chance of more than k errors over that of k at least. Ranks come from windows over a column; the coefficients, 64 by
256 by 256, are computed once by a task. No base is left out: in a column of more than 255 bases, ranks are taken in
proportion to a column of 255.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The factor's floor, the part of it that decays (set by the caller), 10 / ln 10 as rounded in results, bounds of qualities, depth of the table.
FLOOR, DECAY, PHRED, LEAST_QUAL, MOST_QUAL, DEPTH = 0.03, 0.17, 4.343, 4, 63, 255


def log_binomial(n: np.ndarray | int, k: np.ndarray) -> np.ndarray:
    """log of n over k, from a table of log factorials."""
    f = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, DEPTH + 1)))])
    return f[n] - f[k] - f[np.asarray(n) - k]


@cache
def coefficients() -> np.ndarray:
    """[quality, n, k]: phred-scaled log ratio of P(errors > k) to P(errors >= k) in n bases; infinite at k = n."""
    e = 10.0 ** (-np.arange(1, MOST_QUAL + 1) / 10)
    out = np.full((MOST_QUAL + 1, DEPTH + 1, DEPTH + 1), np.inf)
    for n in range(1, DEPTH + 1):
        k = np.arange(n + 1)
        log = log_binomial(n, k) + k * np.log(e)[:, None] + (n - k) * np.log1p(-e)[:, None]
        tail = np.logaddexp.accumulate(log[:, ::-1], axis=1)[:, ::-1]
        out[1:, n, :n] = 10 / np.log(10) * (tail[:, :-1] - tail[:, 1:])
    return out


@F.pandas_udf(T.DoubleType())
def weighted(qual: pd.Series, n: pd.Series, k: pd.Series, w: pd.Series, decay: pd.Series) -> pd.Series:
    n, k = n.to_numpy(np.int64), k.to_numpy(np.int64)
    deep = n > DEPTH
    k = np.where(deep, k * DEPTH // np.maximum(n, 1), k)
    n = np.minimum(n, DEPTH)
    factor = (1 - decay.to_numpy()) ** w.to_numpy() * (1 - FLOOR) + FLOOR
    return pd.Series(factor * coefficients()[qual.to_numpy(np.int64), n, k])


def allele_sums(bases: DataFrame, keys: list[str], allele: str = "allele", qual: str = "qual", strand: str = "strand", decay: float = DECAY) -> DataFrame:
    """(keys, allele, n, error): bases of an allele in a column, and the likelihood of all being errors, phred-scaled. strand: 0 or 1."""
    q = F.least(F.greatest(F.coalesce(F.col(qual), F.lit(0)), F.lit(LEAST_QUAL)), F.lit(MOST_QUAL))
    x = bases.select(*keys, F.col(allele).alias("allele"), q.alias("_q"), F.col(strand).cast("int").alias("_s"))
    # both ranks come from one order, so that equal bases have them in step
    w = Window.partitionBy(*keys, "allele").orderBy(F.desc("_q"), F.desc("_s")).rowsBetween(Window.unboundedPreceding, 0)
    x = x.select("*", F.count("*").over(Window.partitionBy(*keys)).alias("_n"), (F.count("*").over(w) - 1).alias("_k"), F.sum("_s").over(w).alias("_back"))
    x = x.withColumn("_w", F.when(F.col("_s") == 1, F.col("_back") - 1).otherwise(F.col("_k") - F.col("_back")))
    return x.select(*keys, "allele", weighted("_q", "_n", "_k", "_w", F.lit(decay)).alias("e")).groupBy(*keys, "allele").agg(F.count("*").alias("n"), F.sum("e").alias("error"))


def genotypes(sums: DataFrame, keys: list[str], alleles: list) -> DataFrame:
    """(keys, first, second, phred): every unordered pair of the given alleles at every column of allele_sums(), 0 the likeliest possible.
    Bases of other alleles than the pair are errors; between two alleles each base is a toss."""
    of = lambda v, c: F.coalesce(F.max(F.when(F.col("allele") == v, F.col(c))), F.lit(0))
    x = sums.where(F.col("allele").isin(alleles)).groupBy(*keys).agg(*[of(v, "n").alias(f"_n{k}") for k, v in enumerate(alleles)], *[of(v, "error").cast("double").alias(f"_e{k}") for k, v in enumerate(alleles)])
    log = lambda k: F.aggregate(F.sequence(F.lit(1), k), F.lit(0.0), lambda a, y: a + F.log(y.cast("double")))
    rows = []
    for i in range(len(alleles)):
        for j in range(i, len(alleles)):
            e = sum((F.col(f"_e{k}") for k in range(len(alleles)) if k not in (i, j)), F.lit(0.0))
            if i != j:
                a, b = F.col(f"_n{i}").cast("int"), F.col(f"_n{j}").cast("int")
                over = F.when((a > 0) & (b > 0), log(a + b) - log(F.greatest(a, F.lit(1))) - log(F.greatest(b, F.lit(1)))).otherwise(0.0)
                e = e - PHRED * (over - (a + b) * F.log(F.lit(2.0)))
            rows.append(F.struct(F.lit(alleles[i]).alias("first"), F.lit(alleles[j]).alias("second"), F.greatest(e, F.lit(0.0)).alias("phred")))
    return x.select(*keys, F.explode(F.array(*rows)).alias("g")).select(*keys, "g.first", "g.second", "g.phred")
