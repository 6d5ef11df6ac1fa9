"""Genomic views over the driver's tables, the same text for Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: a genome of 13 bases an order on each of five scaffolds, so that the pairs of a join grow with the tables
VIEWS = {
    "fx_features": """SELECT CAST(o_orderkey + 1 AS BIGINT) AS feature_idx, concat('chr', CAST(o_custkey % 5 + 1 AS STRING)) AS scaffold,
  CAST(1 + o_orderkey * 13 + (o_orderkey * 7919) % 5000 AS BIGINT) AS start_pos, CAST(1 + o_orderkey * 13 + (o_orderkey * 7919) % 5000 + 99 + (o_orderkey * 31) % 900 AS BIGINT) AS end_pos,
  CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END AS strand,
  CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'gene' WHEN o_orderpriority = '5-LOW' THEN 'exon' ELSE 'mRNA' END AS feature_type,
  concat('G', CAST(o_orderkey AS STRING)) AS id FROM orders""",
    "fx_bed": """SELECT CAST(l_linenumber AS INT) AS measurement, concat('chr', CAST(l_partkey % 5 + 1 AS STRING)) AS scaffold,
  CAST(1 + l_orderkey * 13 + (l_orderkey * 104729 + l_linenumber * 1299) % 5000 AS BIGINT) AS start_pos,
  CAST(1 + l_orderkey * 13 + (l_orderkey * 104729 + l_linenumber * 1299) % 5000 + CAST(l_quantity AS BIGINT) * 4 AS BIGINT) AS end_pos,
  CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 ELSE 3 END AS strand FROM lineitem""",
    "fx_calls_raw": """SELECT concat('chr', CAST(l_suppkey % 5 + 1 AS STRING)) AS scaffold, CAST(1 + l_orderkey * 13 + (l_orderkey * 7919 + l_linenumber * 37) % 5000 AS BIGINT) AS pos,
  CAST(l_quantity AS INT) AS meth, CAST(l_partkey % 41 AS INT) AS unmeth, CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'N' THEN 0 ELSE 2 END AS context,
  CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS strand, CAST(l_linenumber AS INT) AS file_idx FROM lineitem""",
    # every row of lineitem: genes pair within families of 11, and each first tenth of 1,100 genes with one hub; all steps of row_key are needed to tell rows apart
    "fx_pairs": """SELECT concat('G', CAST(l_orderkey AS STRING)) AS query,
  concat('G', CAST(CAST(CASE WHEN l_orderkey % 1100 < 110 THEN l_orderkey - l_orderkey % 110 ELSE l_orderkey - l_orderkey % 11 + l_partkey % 11 END AS BIGINT) AS STRING)) AS subject,
  l_discount AS dN, l_tax AS dS, 50.0 + l_quantity AS id_subject_query, 50.0 + CAST(l_suppkey % 50 AS DOUBLE) AS id_query_subject,
  (CAST(l_orderkey * 10 + l_linenumber AS BIGINT) * 100000000 + l_partkey * 1000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS row_key FROM lineitem""",
    "fx_tab": "SELECT concat('G', CAST(p_partkey * 5 AS STRING)) AS sample_id, p_retailprice AS v1, CAST(p_size AS DOUBLE) AS v2, CAST(p_partkey AS BIGINT) AS row_idx FROM part",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(re.sub(r"FROM (orders|lineitem|part)\b", lambda m: f"FROM parquet.`{sf_dir}/{m[1]}.parquet`", VIEWS[name]))


def with_views(sql: str) -> str:
    """sql behind the definitions of the views that it names."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql.strip()
    head = "WITH " + ("RECURSIVE " if "RECURSIVE" in sql else "") + ", ".join(f"{n} AS ({VIEWS[n]})" for n in used)
    body = sql.strip().replace("RECURSIVE ", "", 1)
    return f"{head}, {body[5:]}" if body.upper().startswith("WITH ") else f"{head} {body}"
