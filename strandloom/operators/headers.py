"""Union of VCF headers, and numbers of one header's names in another's.

Lines are rows (file, line_no, line) of the meta lines of many files. In the union a definition, a key with an ID, is the
first one's; lines of a key without a structure are those of the first file that has the key; structures without an ID are
the first file's. First is by file, then line. First ones come from aggregates, so that a key in every file is no hot group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Keys whose IDs share numbers; PASS is number 0 among them.
IDS = ("FILTER", "INFO", "FORMAT")


def definitions(lines: DataFrame) -> DataFrame:
    """lines with key, id, number, type and shape: 'defined', 'open' (a structure without ID) or 'plain'. Lines that are no meta lines go."""
    part = lambda name: F.nullif(F.regexp_extract("line", rf"[<,]{name}=([^,>]+)", 1), F.lit(""))
    x = lines.where(F.col("line").rlike("^##[^=]+=")).withColumn("key", F.regexp_extract("line", "^##([^=]+)=", 1))
    inside = F.col("line").rlike("^##[^=]+=<")
    x = x.withColumn("id", F.when(inside, part("ID"))).withColumn("number", F.when(inside, part("Number"))).withColumn("type", F.when(inside, part("Type")))
    return x.withColumn("shape", F.when(~inside, "plain").when(F.col("id").isNull(), "open").otherwise("defined"))


def union(lines: DataFrame) -> DataFrame:
    """(file, line_no, line, key, id, number, type) of the lines kept; file and line_no are their order."""
    d = definitions(lines)
    cols = ["file", "line_no", "line", "key", "id", "number", "type"]
    first = d.where("shape = 'defined'").groupBy("key", "id").agg(F.min(F.struct("file", "line_no", "line", "number", "type")).alias("f")).select("f.file", "f.line_no", "f.line", "key", "id", "f.number", "f.type")
    owner = d.where("shape = 'plain'").groupBy("key").agg(F.min("file").alias("file"))
    plain = d.where("shape = 'plain'").join(owner, ["key", "file"], "left_semi").select(cols)
    opened = d.where("shape = 'open'").join(F.broadcast(d.agg(F.min("file").alias("file"))), "file", "left_semi").select(cols)  # one row
    return first.unionByName(plain).unionByName(opened)


def conflicts(lines: DataFrame) -> DataFrame:
    """(file, line_no, key, id) of INFO and FORMAT lines whose number or type is not the kept definition's."""
    d = definitions(lines).where("shape = 'defined'").where(F.col("key").isin("INFO", "FORMAT"))
    kept = d.groupBy("key", "id").agg(F.min(F.struct("file", "line_no", "number", "type")).alias("f"))
    same = F.col("number").eqNullSafe(F.col("f.number")) & F.col("type").eqNullSafe(F.col("f.type"))
    return d.join(kept, ["key", "id"]).where(~same).select("file", "line_no", "key", "id")


def dictionary(lines: DataFrame, *by: str) -> DataFrame:
    """(by, kind, id, n): numbers of names, kind 'id' or 'contig', in order of first appearance, for each of ``by`` or for all lines."""
    d = definitions(lines).where("shape = 'defined'").withColumn("kind", F.when(F.col("key").isin(*IDS), "id").when(F.col("key") == "contig", "contig")).where("kind is not null")
    at = d.groupBy(*by, "kind", "id").agg(F.min(F.struct("file", "line_no")).alias("at"))
    own = F.row_number().over(Window.partitionBy(*by, "kind").orderBy((F.col("id") != "PASS") | (F.col("kind") != "id"), "at"))
    held = F.max(F.when((F.col("kind") == "id") & (F.col("id") == "PASS"), 1).otherwise(0)).over(Window.partitionBy(*by, "kind"))
    return at.select(*by, "kind", "id", (own - F.when((F.col("kind") == "id") & (held == 0), 0).otherwise(1)).cast("long").alias("n"))


def translation(lines: DataFrame) -> DataFrame:
    """(file, kind, id, own, n): each file's numbers and the union's. Join records to it by file, kind and own number."""
    own = dictionary(lines, "file").withColumnRenamed("n", "own")
    return own.join(dictionary(union(lines).select("file", "line_no", "line")), ["kind", "id"])
