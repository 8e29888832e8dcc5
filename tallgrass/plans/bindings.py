"""The driver's tables read as issues, pair results, labels and ledgers. Each text is valid SQL for Spark and for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sizes import dealt, tasks

PAIRS = """
SELECT 'shop' AS repository, concat('', l_orderkey) AS issue_number, concat('P', l_partkey) AS pattern,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS BIGINT) AS pair_pos,
  CASE WHEN l_linestatus = 'O' AND l_linenumber = 7 THEN 'errored' ELSE 'succeeded' END AS request_status,
  CASE WHEN l_quantity < 3 THEN 'insufficient_context' WHEN l_returnflag = 'A' THEN 'yes' WHEN l_returnflag = 'R' THEN 'uncertain' ELSE 'no' END AS verdict,
  CASE l_suppkey % 4 WHEN 0 THEN 'implemented_existing' WHEN 1 THEN 'proposed_or_planned' WHEN 2 THEN '' ELSE 'conceptual_discussion' END AS adoption_status,
  CASE WHEN l_tax < 0.01 THEN 'yes' WHEN l_tax < 0.03 THEN 'uncertain' ELSE 'no' END AS false_friend_detected,
  concat('evidence ', l_partkey % 5) AS evidence_text, CASE WHEN l_discount < 0.05 THEN 'body' ELSE 'title' END AS evidence_location,
  CASE WHEN l_partkey % 3 = 0 THEN concat('P', l_suppkey) ELSE '' END AS overlap_with,
  CASE WHEN l_discount < 0.03 THEN 'low' WHEN l_discount < 0.07 THEN 'medium' ELSE 'high' END AS confidence,
  l_quantity >= 5 AS mechanism_match, l_suppkey % 7 <> 0 AS scope_match, TRUE AS focus_match, l_extendedprice AS price
FROM {lineitem}
"""
STAGE1 = """
SELECT 'shop' AS repository, concat('', o_orderkey) AS issue_number, concat('shop#', o_orderkey) AS issue_key,
  CASE WHEN o_orderstatus = 'P' THEN 'errored' ELSE 'succeeded' END AS request_status,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'insufficient_context' ELSE 'sufficient' END AS context_status,
  concat('order of ', o_custkey) AS issue_summary, o_orderkey % 6 AS candidate_count, 'no' AS input_truncated,
  'none_explicit' AS issue_challenge_categories, 'other' AS issue_activity_type
FROM {orders}
"""
INPUTS = """
SELECT 'shop' AS repository, concat('', o_orderkey) AS issue_number, concat(' ', o_orderpriority, ' ') AS labels, 'retail' AS repository_category, o_orderstatus AS state, o_orderkey AS pos
FROM {orders}
"""
LABELLED = """
SELECT d.source AS repository, concat('', d.doc_id) AS issue_number, d.doc_id, d.lang, d.n_chars, l.doc_id IS NOT NULL AS labelled,
  CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'yes' WHEN l.quality = 0 AND l.toxic = 0 THEN 'no' WHEN l.quality = 1 THEN 'uncertain' WHEN l.quality = 0 THEN 'insufficient_context' END AS human,
  CASE WHEN d.n_chars >= 1000 THEN 'yes' ELSE 'no' END AS baseline,
  CASE WHEN d.n_chars % 97 = 0 THEN 'uncertain' WHEN d.n_chars >= 1500 THEN 'yes' ELSE 'no' END AS optimized
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""
CALLS = """
SELECT event_id AS pos, CASE WHEN event_type IN ('click', 'purchase') THEN 'stage1' ELSE 'stage2' END AS stage, 'shop' AS repository, concat('', user_id) AS issue_number,
  concat('P', event_id % 9) AS pattern, concat('r', user_id, '-', event_id % 3) AS logical_request_id,
  CAST(row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id) AS BIGINT) AS attempt_number, concat('e', event_id) AS call_id,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 5000 END AS input_tokens, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 700 END AS output_tokens,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 5000 + event_id % 700 END AS total_tokens, CASE WHEN event_id % 2 = 0 THEN event_id % 40 END AS thoughts_tokens,
  CAST(NULL AS BIGINT) AS cached_input_tokens, round(value, 3) AS elapsed_seconds, event_type,
  CASE WHEN event_type = 'error' OR event_id % 13 = 0 THEN 'errored' ELSE 'succeeded' END AS response_status, CASE WHEN event_id % 13 = 0 THEN 'timeout' ELSE '' END AS error
FROM {events}
"""
NAMED = {"pairs": PAIRS, "stage1": STAGE1, "inputs": INPUTS, "labelled": LABELLED, "calls": CALLS}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


#: Tables whose rows are dear to work on, and for those with small rows the megabytes of a task.
_HEAVY = {"documents": None, "pages": None, "events": 2.0, "embeddings": None}


def spread(df: DataFrame, megabytes: float | None = None) -> DataFrame:
    """An input that arrives in fewer pieces than there are cores, or than its ``megabytes`` ask for, dealt out evenly; any other as it is."""
    least = tasks(df, megabytes) if megabytes else df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= least else df.repartition(least)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, _HEAVY[name]) if name in _HEAVY else df


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a text whose tables stand in braces."""
    names = {n for n in re.findall(r"\{(\w+)\}", text) if n in TABLES}
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "pairs":  # numbered within an order: dealt for that to tasks of a bounded size
        return spark.sql(PAIRS, lineitem=dealt(table(spark, sf_dir, "lineitem"), "l_orderkey"))
    return sql(spark, sf_dir, NAMED[name])


def oracle(*names: str) -> str:
    """WITH clause of the named bindings for DuckDB, open for more."""
    return "WITH " + ",\n".join(f"{n} AS ({re.sub(r'[{}]', '', NAMED[n])})" for n in names)
