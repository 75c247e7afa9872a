"""Views on the driver's tables under which every operator can be run, as SQL that Spark and DuckDB both read.

``//`` stands for integer division and is written as ``div`` for Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "obs": """
        WITH b AS (SELECT l_orderkey % 3 AS chrom, l_orderkey AS read_id, (l_orderkey // 12) + l_linenumber AS pos, CAST(l_quantity AS INT) AS qual, l_discount FROM lineitem)
        SELECT chrom, read_id, pos, max((read_id // 3 + (pos * 7919) % 13 + CASE WHEN l_discount >= 0.095 THEN 1 ELSE 0 END) % 2) AS allele, max(qual) AS qual,
               CASE pos % 20 WHEN 0 THEN 3 WHEN 10 THEN 4 WHEN 15 THEN 2 WHEN 5 THEN 1 ELSE 0 END AS vtype
        FROM b GROUP BY chrom, read_id, pos""",
    "obs_gapped": """
        WITH b AS (SELECT l_orderkey % 3 AS chrom, l_orderkey AS read_id, (l_orderkey // 12) + 20 * (l_orderkey // 240) + l_linenumber AS pos, CAST(l_quantity AS INT) AS qual, l_discount FROM lineitem)
        SELECT chrom, read_id, pos, max((read_id // 3 + (pos * 7919) % 13 + CASE WHEN l_discount >= 0.095 THEN 1 ELSE 0 END) % 2) AS allele, max(qual) AS qual,
               CASE pos % 20 WHEN 0 THEN 3 WHEN 10 THEN 4 WHEN 15 THEN 2 WHEN 5 THEN 1 ELSE 0 END AS vtype
        FROM b GROUP BY chrom, read_id, pos""",
    "obs_dense": """
        SELECT chrom, read_id, pos, (max(read_id // 3) + (pos * 7919) % 13) % 2 AS allele, max(qual) AS qual, CASE pos % 3 WHEN 0 THEN 0 ELSE 2 END AS vtype
        FROM (SELECT l_orderkey % 3 AS chrom, l_orderkey AS read_id, (l_orderkey // 240) * 4 + l_linenumber AS pos, CAST(l_quantity AS INT) AS qual FROM lineitem) b GROUP BY chrom, read_id, pos""",
    "aln": """
        SELECT l_orderkey % 3 AS chrom, l_orderkey AS read_id, min((l_orderkey // 12) + l_linenumber) AS start_pos, max((l_orderkey // 12) + l_linenumber) AS end_pos,
               l_orderkey % 2 AS strand, max(CAST(l_quantity AS INT)) AS mapq, max(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 16 ELSE 256 END) AS flag,
               max(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 16 ELSE 256 END) + CASE l_orderkey % 7 WHEN 0 THEN 2048 WHEN 1 THEN 1024 WHEN 2 THEN 4 ELSE 0 END AS flag2
        FROM lineitem GROUP BY l_orderkey""",
    "variants": """
        SELECT chrom, pos, min(vtype) AS vtype, CASE pos % 3 WHEN 0 THEN '0/1' WHEN 1 THEN '1|0' ELSE '1/1' END AS gt,
               substring('ACGT', CAST(pos % 4 AS INT) + 1, 1) AS ref,
               CASE WHEN pos % 11 = 0 THEN 'A,C' WHEN pos % 5 = 0 THEN substring('CGTA', CAST(pos % 4 AS INT) + 1, 1) || 'GT' ELSE substring('CGTA', CAST(pos % 4 AS INT) + 1, 1) END AS alt,
               CASE WHEN pos % 6 = 0 THEN NULL ELSE CAST(pos % 50 AS DOUBLE) END AS qual
        FROM obs GROUP BY chrom, pos""",
    "sv": """
        SELECT o_orderkey % 3 AS chrom, o_orderkey AS ord, o_orderkey // 12 AS pos, CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * (1 + CAST(floor(o_totalprice) AS BIGINT) % 400) AS svlen
        FROM orders WHERE o_orderkey % 5 = 0""",
    "calls": """
        SELECT user_id % 3 AS chrom, event_id // 10 AS pos, user_id AS read_id, event_id AS scan_ord, CAST(CAST(floor(value) AS BIGINT) % 256 AS INT) AS prob, (event_id // 10) % 2 AS strand, event_type FROM events""",
    "intervals": """
        SELECT user_id % 3 AS chrom, user_id AS iv, min(event_id) AS start_pos, min(event_id) + 40 + user_id % 200 AS end_pos FROM events GROUP BY user_id""",
    "assigned": """
        SELECT DISTINCT chrom, pos, CAST((pos * 7919) % 13 % 2 + 1 AS INT) AS hp, (pos // 50) * 50 + 1 AS ps FROM obs""",
    "cigars": """
        SELECT o_orderkey AS aln_id, o_orderkey % 3 AS chrom, o_orderkey AS pos, o_orderkey % 8 AS flag,
               concat(o_orderkey % 7, 'S', 5 + o_orderkey % 30, 'M', 1 + o_orderkey % 4, 'I', 3 + o_orderkey % 9, '=', 1 + o_orderkey % 5, 'D', 2 + o_orderkey % 6, 'X', 1 + o_orderkey % 3, 'H') AS cigar
        FROM orders""",
    "vcf": """
        SELECT chrom, pos, CASE pos % 2 WHEN 0 THEN 'GT:DP:PS' ELSE 'GT:PS:AD' END AS format,
               CASE pos % 2 WHEN 0 THEN concat(gt, ':', pos % 40, ':', pos + 1) ELSE concat(gt, ':', pos + 1, ':', pos % 9) END AS sample,
               concat('SVTYPE=DEL;SVLEN=', -(pos % 300), ';END=', pos + 3) AS info FROM variants""",
}

#: Views that another one reads.
NEEDS = {"variants": ["obs"], "assigned": ["obs"], "vcf": ["variants"]}


def _order(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        out += [x for x in [*_order(tuple(NEEDS.get(n, []))), n] if x not in out]
    return out


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL over the views."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in _order(names)) + " " + sql


TABLES = ("lineitem", "orders", "events", "documents", "part", "customer")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame, without registering anything in the session's catalog under a fixed name."""
    text = ("WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in _order((name,))) + f" SELECT * FROM {name}").replace("//", "div")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"FROM {t}" in text}
    for t in used:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **used)
