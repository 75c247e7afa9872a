"""Where operators keep intermediate tables.

A table that cuts lineage is written as Parquet below ``spark.checkpoint.dir``, the one
folder that the driver and all executors share, so that it survives the loss of any executor.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; one of our own only where none is set and all runs on this machine, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="strandloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Rows of a batch that goes to a Python worker. Texts have some kB each, so that Spark's 10,000 would fill many times that memory in worker and executor.
BATCH = 1000
#: Bytes of such a batch, about: a thousand sets of long texts have many times that.
BATCH_BYTES = 1 << 22


def bounded(spark: SparkSession) -> None:
    """Lets this session send at most BATCH rows or about BATCH_BYTES at a time to Python workers; a smaller number of rows stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "0")) <= BATCH:
        spark.conf.set(key, str(BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df once to the shared folder and return the table read from there."""
    spark, at = df.sparkSession, new_path(df.sparkSession, tag)
    bounded(spark)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Remove a table made by stored() that no later plan reads."""
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of plans that are no longer held."""
    gc.collect()
    spark._jvm.System.gc()
