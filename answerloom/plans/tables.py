"""How the given tables stand for the knowledge tables (Spark side and SQL side of the same mapping)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def knowledge_documents(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_nationkey")
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("document_id"), F.col("c_mktsegment").alias("owner"),
        (key % 5).cast("string").alias("domain"), F.col("c_name").alias("title"),
        F.when(key % 3 == 0, F.array(F.lit("public"))).when(key % 3 == 1, F.array(F.lit("public"), F.lit("vip")))
        .otherwise(F.array(F.lit("staff"))).alias("access_scope"),
        F.when(F.col("c_acctbal") < 0, "deleted").otherwise("active").alias("document_status"),
    )


def knowledge_versions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("document_id"),
        F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "P", "failed")
        .otherwise("pending").alias("version_status"),
        (F.substring("o_orderpriority", 1, 1) <= "3").alias("is_current"), F.col("o_orderdate").alias("created_at"),
    )


def knowledge_indexes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.concat(F.lit("ix"), F.col("o_orderkey").cast("string")).alias("index_version_id"),
        F.col("o_orderkey").alias("version_id"),
        F.when(F.col("o_totalprice") > 100000, "active").otherwise("superseded").alias("index_status"),
        F.concat(F.lit("c"), F.substring("o_orderpriority", 1, 1)).alias("collection"),
        F.when(F.col("o_orderkey") % 4 == 0, "m-old").otherwise("m-new").alias("model"),
        F.when(F.col("o_orderkey") % 7 == 0, 64).otherwise(128).alias("dimension"),
    )


def knowledge_chunks(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("l_orderkey").cast("string")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct().select(
        F.concat_ws("-", key, F.col("l_linenumber").cast("string")).alias("chunk_id"),
        F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").cast("long").alias("ordinal"),
        F.when(F.col("l_linenumber") == 1, "parent").otherwise("child").alias("kind"),
        F.when(F.col("l_linenumber") > 1, F.concat(key, F.lit("-1"))).alias("parent_chunk_id"),
    )


def knowledge_jobs(spark: SparkSession, d: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("version_id"),
        (F.col("l_partkey") * 100000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("job_id"),
        F.col("l_shipdate").alias("created_at"),
        F.when(flag == "R", "failed").when(flag == "A", "succeeded").otherwise("running").alias("job_status"),
        F.concat(F.lit("E_"), F.col("l_linestatus")).alias("error_code"),
    )


def retrieval_requests(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey")
    owners = F.array(*[F.lit(s) for s in SEGMENTS])
    return table(spark, d, "supplier").select(
        key.alias("query_id"), F.element_at(owners, (key % 5 + 1).cast("int")).alias("owner"),
        (F.col("s_nationkey") % 5).cast("string").alias("domain"),
        F.when(key % 2 == 0, F.array(F.lit("public"))).otherwise(F.array(F.lit("vip"), F.lit("staff")))
        .alias("allowed_scopes"),
        F.when(key % 3 == 0, "vector").when(key % 3 == 1, "bm25").otherwise("hybrid").alias("mode"),
    )


# The same mapping for DuckDB; every oracle that needs it starts with this WITH list.
KNOWLEDGE_SQL = """
kd AS (SELECT c_custkey AS document_id, c_mktsegment AS owner, CAST(c_nationkey % 5 AS VARCHAR) AS domain, c_name AS title,
        CASE WHEN c_nationkey % 3 = 0 THEN ['public'] WHEN c_nationkey % 3 = 1 THEN ['public','vip'] ELSE ['staff'] END AS access_scope,
        CASE WHEN c_acctbal < 0 THEN 'deleted' ELSE 'active' END AS document_status FROM customer),
kv AS (SELECT o_orderkey AS version_id, o_custkey AS document_id,
        CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'P' THEN 'failed' ELSE 'pending' END AS version_status,
        substr(o_orderpriority, 1, 1) <= '3' AS is_current, o_orderdate AS created_at FROM orders),
ki AS (SELECT 'ix' || CAST(o_orderkey AS VARCHAR) AS index_version_id, o_orderkey AS version_id,
        CASE WHEN o_totalprice > 100000 THEN 'active' ELSE 'superseded' END AS index_status,
        'c' || substr(o_orderpriority, 1, 1) AS collection,
        CASE WHEN o_orderkey % 4 = 0 THEN 'm-old' ELSE 'm-new' END AS model,
        CASE WHEN o_orderkey % 7 = 0 THEN 64 ELSE 128 END AS dimension FROM orders),
kc AS (SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS chunk_id, l_orderkey AS version_id,
        CAST(l_linenumber AS BIGINT) AS ordinal, CASE WHEN l_linenumber = 1 THEN 'parent' ELSE 'child' END AS kind,
        CASE WHEN l_linenumber > 1 THEN CAST(l_orderkey AS VARCHAR) || '-1' END AS parent_chunk_id
        FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
kj AS (SELECT l_orderkey AS version_id, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS job_id, l_shipdate AS created_at,
        CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'succeeded' ELSE 'running' END AS job_status,
        'E_' || l_linestatus AS error_code FROM lineitem),
kr AS (SELECT s_suppkey AS query_id, ['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'][s_suppkey % 5 + 1] AS owner,
        CAST(s_nationkey % 5 AS VARCHAR) AS domain,
        CASE WHEN s_suppkey % 2 = 0 THEN ['public'] ELSE ['vip','staff'] END AS allowed_scopes,
        CASE s_suppkey % 3 WHEN 0 THEN 'vector' WHEN 1 THEN 'bm25' ELSE 'hybrid' END AS mode FROM supplier),
live AS (SELECT ki.*, kv.document_id, kd.owner, kd.domain, kd.access_scope, kd.title FROM ki JOIN kv USING (version_id)
        JOIN kd USING (document_id)
        WHERE index_status = 'active' AND version_status = 'ready' AND is_current AND document_status = 'active')
"""
