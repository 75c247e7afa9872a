"""The aggregates of the commands as streams: observations that arrive in files are counted without reading the past again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBS = "chrom long, read_id long, pos long, allele long, qual int, vtype int"


def observations(spark: SparkSession, path: str, schema: str = OBS) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def allele_depths(obs: DataFrame) -> DataFrame:
    """Running counts of both alleles by position (update or complete mode); state is one row a position."""
    return obs.groupBy("chrom", "pos").agg(F.count_if(F.col("allele") == 0).alias("n_ref"), F.count_if(F.col("allele") == 1).alias("n_alt"))


def read_votes(obs: DataFrame, phased: DataFrame) -> DataFrame:
    """Running haplotype votes by read against a fixed phased table."""
    x = obs.join(phased.select("chrom", "pos", "hp"), ["chrom", "pos"])
    hap = F.when(F.col("allele") == 0, F.col("hp")).otherwise(3 - F.col("hp"))
    return x.groupBy("chrom", "read_id").agg(F.count_if(hap == 1).alias("h1"), F.count_if(hap == 2).alias("h2"))
