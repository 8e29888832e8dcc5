"""Queries over stage results: roll-up, work lists, integrity, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import ledger, metrics, rollup, stages
from ..operators.responses import downgrade
from ..types import KEY, PAIR_KEY
from ..streaming.ledger import run_once, windowed
from .bindings import bound, oracle, sql
from .registry import registry

QUERIES, SQL, query = registry()

ROLLUP = (
    oracle("pairs", "stage1", "inputs")
    + """,
g AS (SELECT repository, issue_number, count(*) FILTER (WHERE request_status = 'succeeded') AS good, count(*) FILTER (WHERE request_status <> 'succeeded') AS bad,
  string_agg(pattern, '|' ORDER BY pair_pos) FILTER (WHERE request_status = 'succeeded' AND verdict = 'yes') AS yes,
  string_agg(pattern, '|' ORDER BY pair_pos) FILTER (WHERE request_status = 'succeeded' AND verdict = 'uncertain') AS unsure,
  string_agg(pattern, '|' ORDER BY pair_pos) FILTER (WHERE request_status = 'succeeded' AND verdict = 'insufficient_context') AS scant,
  count(DISTINCT adoption_status) FILTER (WHERE request_status = 'succeeded' AND verdict <> 'no' AND adoption_status <> '') AS statuses,
  min(adoption_status) FILTER (WHERE request_status = 'succeeded' AND verdict <> 'no' AND adoption_status <> '') AS status,
  bool_or(request_status = 'succeeded' AND false_friend_detected = 'yes') AS friend, bool_or(request_status = 'succeeded' AND false_friend_detected = 'uncertain') AS maybe,
  min(CASE confidence WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) FILTER (WHERE request_status = 'succeeded' AND verdict <> 'no') AS conf
  FROM pairs GROUP BY ALL),
t AS (SELECT repository, issue_number, pair_pos, unnest(['e', 'l', 'o']) AS k, unnest([evidence_text, evidence_location, overlap_with]) AS v FROM pairs WHERE request_status = 'succeeded' AND verdict <> 'no'),
u AS (SELECT repository, issue_number, k, v, min(pair_pos) AS p FROM t WHERE v <> '' GROUP BY ALL),
w AS (SELECT repository, issue_number, string_agg(v, '|' ORDER BY p) FILTER (WHERE k = 'e') AS e, string_agg(v, '|' ORDER BY p) FILTER (WHERE k = 'l') AS l,
  string_agg(v, '|' ORDER BY p) FILTER (WHERE k = 'o') AS o FROM u GROUP BY ALL),
r AS (SELECT s.*, g.*, w.e, w.l, w.o, i.labels, i.state, i.repository_category,
  CASE WHEN s.request_status <> 'succeeded' OR coalesce(bad, 0) > 0 THEN 'pipeline_error' WHEN yes IS NOT NULL THEN 'yes' WHEN unsure IS NOT NULL THEN 'uncertain'
    WHEN scant IS NOT NULL OR s.context_status = 'insufficient_context' THEN 'insufficient_context' ELSE 'no' END AS relevance
  FROM stage1 s LEFT JOIN g USING (repository, issue_number) LEFT JOIN w USING (repository, issue_number) LEFT JOIN inputs i USING (repository, issue_number))
"""
)


@query(
    ROLLUP
    + """SELECT repository, issue_number, relevance AS relevant_to_pattern_study, coalesce(yes, '') AS patterns_confirmed, coalesce(unsure, '') AS patterns_uncertain,
  coalesce(scant, '') AS patterns_insufficient_context, concat_ws('|', yes, unsure, scant) AS patterns_present,
  CASE WHEN statuses = 1 THEN status WHEN statuses > 1 THEN 'multiple' WHEN relevance = 'insufficient_context' THEN 'insufficient_context' ELSE 'not_related' END AS adoption_status,
  CASE WHEN friend THEN 'yes' WHEN maybe THEN 'uncertain' ELSE 'no' END AS false_friend_detected, coalesce(e, '') AS evidence_text, coalesce(l, '') AS evidence_location,
  coalesce(o, '') AS overlapping_patterns, CASE conf WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE '' END AS confidence, coalesce(good, 0) AS stage2_pair_count,
  CASE WHEN request_status <> 'succeeded' THEN 1 ELSE 0 END + coalesce(bad, 0) AS pipeline_error_count, coalesce(trim(labels), '') AS labels, coalesce(state, '') AS state,
  coalesce(repository_category, '') AS repository_category FROM r"""
)
def issue_rollup(spark: SparkSession, d: str) -> DataFrame:
    out = rollup.rollup(bound(spark, d, "stage1"), bound(spark, d, "pairs"), bound(spark, d, "inputs"), input_pos="pos")
    return out.select(
        *KEY, "relevant_to_pattern_study", "patterns_confirmed", "patterns_uncertain", "patterns_insufficient_context", "patterns_present", "adoption_status", "false_friend_detected",
        "evidence_text", "evidence_location", "overlapping_patterns", "confidence", "stage2_pair_count", "pipeline_error_count", "labels", "state", "repository_category",
    )


def _expected(spark: SparkSession, d: str) -> DataFrame:
    """Stage 1 with its candidates as a JSON list: the parts of each order, first of equals."""
    return sql(spark, d, "SELECT 'shop' AS repository, concat('', l_orderkey) AS issue_number, 'succeeded' AS request_status, to_json(sort_array(collect_set(concat('P', l_partkey)))) AS candidates FROM {lineitem} GROUP BY l_orderkey")


EXPECTED = "expected AS (SELECT 'shop' AS repository, concat('', l_orderkey) AS issue_number, concat('P', l_partkey) AS pattern FROM lineitem GROUP BY ALL)"
GIVEN = "given AS (SELECT * FROM pairs WHERE price < 40000 AND pattern <> 'P7'), extra AS (SELECT repository, issue_number, 'X' AS pattern, pair_pos, 'succeeded' AS request_status, verdict FROM pairs WHERE pair_pos = 1 AND price > 60000)"


def _given(spark: SparkSession, d: str) -> DataFrame:
    pairs = bound(spark, d, "pairs")
    extra = pairs.where("pair_pos = 1 and price > 60000").select("repository", "issue_number", F.lit("X").alias("pattern"), "pair_pos", F.lit("succeeded").alias("request_status"), "verdict")
    return pairs.where("price < 40000 and pattern <> 'P7'").select(*extra.columns).unionByName(extra)


@query("WITH " + EXPECTED + " SELECT * , CAST(row_number() OVER (PARTITION BY repository, issue_number ORDER BY pattern) - 1 AS INTEGER) AS candidate_pos FROM expected")
def stage2_pairs(spark: SparkSession, d: str) -> DataFrame:
    return stages.explode_pairs(_expected(spark, d), strict=False).select(*PAIR_KEY, "candidate_pos")


@query(
    oracle("pairs") + ", " + EXPECTED + ", " + GIVEN + """,
a AS (SELECT repository, issue_number, pattern, count(*) AS n, count(*) FILTER (WHERE request_status = 'succeeded') AS good
  FROM (SELECT repository, issue_number, pattern, request_status FROM given UNION ALL SELECT repository, issue_number, pattern, request_status FROM extra) GROUP BY ALL),
j AS (SELECT e.pattern IS NOT NULL AS wanted, coalesce(n, 0) AS n, coalesce(good, 0) AS good FROM expected e FULL JOIN a USING (repository, issue_number, pattern)),
c AS (SELECT count(*) FILTER (WHERE wanted) AS expected_pairs, count(*) FILTER (WHERE wanted AND good > 0) AS completed_pairs, count(*) FILTER (WHERE wanted AND good = 0) AS missing_pairs,
  count(*) FILTER (WHERE NOT wanted AND good > 0) AS extra_pairs, count(*) FILTER (WHERE good = 0 AND n > 0) AS failed_pairs, count(*) FILTER (WHERE good > 1) AS repeated_pairs FROM j)
SELECT *, CASE WHEN missing_pairs + extra_pairs + failed_pairs + repeated_pairs = 0 THEN 'OK' ELSE 'FAILED' END AS status FROM c"""
)
def integrity_report(spark: SparkSession, d: str) -> DataFrame:
    return stages.integrity(stages.explode_pairs(_expected(spark, d), strict=False), _given(spark, d))


@query(oracle("pairs") + ", " + EXPECTED + ", " + GIVEN + """ SELECT * FROM expected e WHERE NOT EXISTS (SELECT 1 FROM given g WHERE g.repository = e.repository
  AND g.issue_number = e.issue_number AND g.pattern = e.pattern AND g.request_status = 'succeeded')""")
def pending_pairs(spark: SparkSession, d: str) -> DataFrame:
    return stages.pending(stages.explode_pairs(_expected(spark, d), strict=False), _given(spark, d)).select(*PAIR_KEY)


@query("""WITH a AS (SELECT concat('', o_orderkey) AS issue_number, o_orderstatus AS status, CAST(NULL AS DOUBLE) AS price FROM orders WHERE o_orderkey % 3 <> 1),
b AS (SELECT concat('', o_orderkey) AS issue_number, 'new' AS status, o_totalprice AS price FROM orders WHERE o_orderkey % 4 = 0)
SELECT * FROM a WHERE issue_number NOT IN (SELECT issue_number FROM b) UNION ALL SELECT * FROM b""")
def upsert_results(spark: SparkSession, d: str) -> DataFrame:
    old = sql(spark, d, "SELECT concat('', o_orderkey) AS issue_number, o_orderstatus AS status FROM {orders} WHERE o_orderkey % 3 <> 1")
    new = sql(spark, d, "SELECT concat('', o_orderkey) AS issue_number, 'new' AS status, o_totalprice AS price FROM {orders} WHERE o_orderkey % 4 = 0")
    return stages.upsert(old, new, ["issue_number"])


@query(oracle("calls") + " SELECT logical_request_id, pos, attempt_number, stage, response_status, total_tokens FROM calls QUALIFY row_number() OVER (PARTITION BY logical_request_id ORDER BY attempt_number DESC, pos DESC) = 1")
def latest_attempt(spark: SparkSession, d: str) -> DataFrame:
    return ledger.final_attempts(bound(spark, d, "calls")).select("logical_request_id", "pos", "attempt_number", "stage", "response_status", "total_tokens")


SUMMARY = ("calls", "usage_complete", "total_input_tokens", "input_tokens_measured_calls", "total_thoughts_tokens", "total_cached_input_tokens", "mean_input_tokens_stage1", "median_input_tokens_stage2", "p95_input_tokens_stage1", "p95_latency_seconds", "retries", "logical_calls", "successful_calls", "failed_calls", "issues", "stage1_calls", "stage2_successful_calls", "requests_per_hour", "estimated_cost_if_api", "tokens_saved_vs_baseline")


@query(
    oracle("calls") + """, f AS (SELECT *, response_status = 'succeeded' AND error = '' AS ok FROM calls QUALIFY row_number() OVER (PARTITION BY logical_request_id ORDER BY attempt_number DESC, pos DESC) = 1),
a AS (SELECT count(*) AS calls, count(*) > 0 AND count(*) = count(total_tokens) AS usage_complete, sum(input_tokens)::BIGINT AS total_input_tokens, count(input_tokens) AS input_tokens_measured_calls,
  sum(thoughts_tokens)::BIGINT AS total_thoughts_tokens, sum(cached_input_tokens)::BIGINT AS total_cached_input_tokens, avg(input_tokens) FILTER (WHERE stage = 'stage1') AS mean_input_tokens_stage1,
  quantile_cont(input_tokens, 0.5) FILTER (WHERE stage = 'stage2') AS median_input_tokens_stage2, quantile_cont(input_tokens, 0.95) FILTER (WHERE stage = 'stage1') AS p95_input_tokens_stage1,
  quantile_cont(elapsed_seconds, 0.95) AS p95_latency_seconds, count(*) FILTER (WHERE attempt_number > 1) AS retries FROM calls),
b AS (SELECT count(*) AS logical_calls, count(*) FILTER (WHERE ok) AS successful_calls, count(*) FILTER (WHERE NOT ok) AS failed_calls, count(DISTINCT (repository, issue_number)) AS issues,
  count(*) FILTER (WHERE stage = 'stage1') AS stage1_calls, count(*) FILTER (WHERE ok AND stage = 'stage2') AS stage2_successful_calls FROM f)
SELECT *, successful_calls * 3600.0 / 7200.0 AS requests_per_hour, CAST(NULL AS DOUBLE) AS estimated_cost_if_api, CAST(NULL AS BIGINT) AS tokens_saved_vs_baseline FROM a, b"""
)
def call_summary(spark: SparkSession, d: str) -> DataFrame:
    return ledger.summarize(bound(spark, d, "calls"), wall_seconds=7200.0, input_price=1.0, output_price=4.0, baseline_total=10**9).select(*SUMMARY)


@query("SELECT event_type, count(value) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, median(value) AS median, quantile_cont(value, 0.95) AS p95, min(value) AS minimum, max(value) AS maximum FROM events GROUP BY event_type")
def stage_distribution(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.distribution(sql(spark, d, "SELECT event_type, value FROM {events}"), "value", ["event_type"])
    return out.withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6)})


@query(oracle("calls") + " SELECT stage, count(*) AS calls, count(*) FILTER (WHERE response_status = 'succeeded') AS succeeded, round(sum(elapsed_seconds), 3) AS seconds, round(count(*) * 3600.0 / sum(elapsed_seconds), 4) AS calls_per_hour FROM calls GROUP BY stage")
def throughput_by_stage(spark: SparkSession, d: str) -> DataFrame:
    seconds = F.sum("elapsed_seconds")
    return bound(spark, d, "calls").groupBy("stage").agg(
        F.count("*").alias("calls"), F.count_if(F.col("response_status") == "succeeded").alias("succeeded"), F.round(seconds, 3).alias("seconds"), F.round(F.try_divide(F.count("*") * 3600.0, seconds), 4).alias("calls_per_hour")
    )


@query(
    ROLLUP.rstrip()
    + """, m AS (SELECT s.issue_number, s.candidate_count > 0 AS cand, g.issue_number IS NOT NULL AS has, g.yes IS NOT NULL AS yes, r.relevance = 'yes' AS fin FROM stage1 s LEFT JOIN g USING (repository, issue_number) JOIN r ON r.issue_number = s.issue_number)
SELECT count(*) AS issues, count(*) FILTER (WHERE cand) AS with_candidates, count(*) FILTER (WHERE has) AS with_pairs, count(*) FILTER (WHERE yes) AS with_yes, count(*) FILTER (WHERE fin) AS final_yes,
  count(*) FILTER (WHERE yes AND NOT fin) AS yes_not_final, count(*) FILTER (WHERE fin AND NOT yes) AS final_not_yes FROM m"""
)
def stage_funnel(spark: SparkSession, d: str) -> DataFrame:
    stage1, pairs = bound(spark, d, "stage1"), bound(spark, d, "pairs")
    return stages.funnel(stage1, pairs, rollup.rollup(stage1, pairs))


CONFIDENCE = """CASE WHEN verdict = 'insufficient_context' THEN 'low' WHEN verdict = 'no' THEN CASE WHEN length(text) >= 15 THEN 'medium' ELSE 'low' END
  WHEN verdict = 'uncertain' THEN CASE WHEN length(text) < 15 OR false_friend_detected = 'yes' THEN 'low' ELSE 'medium' END
  WHEN false_friend_detected = 'yes' OR length(text) < 15 THEN 'low' WHEN NOT (mechanism_match AND scope_match AND focus_match) THEN 'medium'
  WHEN adoption_status IN ('superficial_mention', 'not_related') THEN 'low' WHEN length(text) >= 50 THEN 'high' ELSE 'medium' END"""
EVIDENCE = "repeat('x', CAST(floor(price) AS INTEGER) % 70)"


@query(oracle("pairs") + f", p AS (SELECT *, {EVIDENCE} AS text FROM pairs) SELECT verdict, {CONFIDENCE} AS computed, count(*) AS pairs FROM p GROUP BY ALL")
def confidence_rules(spark: SparkSession, d: str) -> DataFrame:
    pairs = bound(spark, d, "pairs").withColumn("text", F.expr(EVIDENCE))
    c = [F.col(n) for n in ("verdict", "text", "false_friend_detected", "adoption_status", "mechanism_match", "scope_match", "focus_match")]
    return pairs.select("verdict", rules.stage2_confidence(*c).alias("computed")).groupBy("verdict", "computed").agg(F.count("*").alias("pairs"))


@query(
    oracle("pairs") + """, p AS (SELECT *, verdict = 'yes' AND NOT (mechanism_match AND scope_match AND focus_match) AS down,
  concat_ws(', ', CASE WHEN NOT mechanism_match THEN 'mechanism_match' END, CASE WHEN NOT scope_match THEN 'scope_match' END, CASE WHEN NOT focus_match THEN 'focus_match' END) AS gone FROM pairs)
SELECT issue_number, pair_pos, CASE WHEN down THEN 'uncertain' ELSE verdict END AS verdict, CASE WHEN down THEN concat('[auto-downgraded yes→uncertain: ', gone, ' ausente] ', evidence_text) ELSE evidence_text END AS justification,
  CASE WHEN down AND adoption_status IN ('superficial_mention', 'not_related') THEN 'conceptual_discussion' ELSE adoption_status END AS adoption_status FROM p"""
)
def response_downgrade(spark: SparkSession, d: str) -> DataFrame:
    return downgrade(bound(spark, d, "pairs").withColumn("justification", F.col("evidence_text"))).select("issue_number", "pair_pos", "verdict", "justification", "adoption_status")


@query(oracle("pairs") + """, p AS (SELECT *, CASE WHEN verdict = 'yes' THEN CASE WHEN false_friend_detected = 'no' THEN 'TP' ELSE 'FP' END ELSE 'TN' END AS label FROM pairs),
e AS (SELECT pattern, evidence_text, min(CAST(issue_number AS BIGINT) * 100 + pair_pos) AS p FROM p WHERE label = 'FP' GROUP BY ALL), s AS (SELECT pattern, string_agg(evidence_text, '|' ORDER BY p) AS evidence FROM e GROUP BY pattern)
SELECT pattern, count(*) FILTER (WHERE label = 'FP') AS fp, count(*) FILTER (WHERE label = 'TP') AS tp, any_value(evidence) AS evidence, round(count(*) FILTER (WHERE label = 'FP') / count(*) FILTER (WHERE label IN ('FP', 'TP')), 6) AS fp_share
FROM p JOIN s USING (pattern) GROUP BY pattern HAVING fp > 0""")
def pattern_fp_summary(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("verdict") == "yes", F.when(F.col("false_friend_detected") == "no", "TP").otherwise("FP")).otherwise("TN")
    rows = bound(spark, d, "pairs").withColumns({"label": label, "at": F.col("issue_number").cast("long") * 100 + F.col("pair_pos")})
    out = metrics.false_positive_patterns(rows, "pattern", "label", "evidence_text", "at")
    return out.select("pattern", "fp", "tp", F.array_join("evidence", "|").alias("evidence"), F.round("fp_share", 6).alias("fp_share"))


@query("""WITH j AS (SELECT user_id AS job_pos, concat('job', user_id) AS name, user_id % 5 = 0 AS consumed, concat('c', event_id % 4) AS custom_id, max(event_type) AS digest FROM events GROUP BY ALL),
r AS (SELECT 'c0' AS custom_id, 'view' AS digest UNION ALL SELECT 'c1', 'view'),
h AS (SELECT job_pos, name, count(DISTINCT j.custom_id) AS held FROM j JOIN r USING (custom_id, digest) WHERE NOT consumed GROUP BY ALL) SELECT job_pos, name FROM h WHERE held = 2 ORDER BY job_pos DESC LIMIT 1""")
def remote_job_reuse(spark: SparkSession, d: str) -> DataFrame:
    rows = sql(spark, d, "SELECT user_id AS job_pos, concat('job', user_id) AS name, user_id % 5 = 0 AS consumed, concat('c', event_id % 4) AS custom_id, max(event_type) AS digest FROM {events} GROUP BY ALL")
    jobs = rows.groupBy("job_pos", "name", "consumed").agg(F.map_from_entries(F.collect_list(F.struct("custom_id", "digest"))).alias("requests")).withColumn("model", F.lit("m"))
    requests = spark.createDataFrame([("c0", "view"), ("c1", "view")], "custom_id string, digest string")
    return stages.reusable_job(jobs, requests, "m")


@query("""WITH RECURSIVE q AS (SELECT source AS run, doc_id AS pos, strlen(text) + 1 AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
f AS (SELECT run, k, pos, 0 AS b, 1 AS n, 2 + s AS u FROM q WHERE k = 1 UNION ALL
  SELECT q.run, q.k, q.pos, f.b + (CASE WHEN f.n >= 20 OR f.u + q.s > 1000000 THEN 1 ELSE 0 END), CASE WHEN f.n >= 20 OR f.u + q.s > 1000000 THEN 1 ELSE f.n + 1 END,
    CASE WHEN f.n >= 20 OR f.u + q.s > 1000000 THEN 2 + q.s ELSE f.u + q.s END FROM f JOIN q ON q.run = f.run AND q.k = f.k + 1)
SELECT run, pos, b::INTEGER AS batch FROM f""")
def batch_packing(spark: SparkSession, d: str) -> DataFrame:
    requests = sql(spark, d, "SELECT source AS run, doc_id AS pos, CAST(octet_length(text) AS BIGINT) AS bytes FROM {documents}")
    return stages.pack_requests(requests, "run", "pos", "bytes", 20, 1_000_000).select("run", "pos", "batch")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(DISTINCT event_id) AS calls FROM events GROUP BY ALL")
def ledger_stream(spark: SparkSession, d: str) -> DataFrame:
    """The table read as a stream of files: replays dropped, calls counted per hour."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    calls = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    out = run_once(windowed(calls.dropDuplicates(["event_id"]), "ts", "1 hour", ["event_type"]))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))
