"""Queries of the request flow: prompts, compact answers, evidence, checks of inputs, and whole runs on stored answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import once, part_of, percent, quantization, stable_id
from ..operators import audit, metrics, requests, responses, retrieval, stages
from ..operators.prepare import validate_input
from ..scratch import new_path
from ..sizes import dealt
from ..sources import files, sinks
from ..types import KEY, PAIR_KEY
from . import composites
from .bindings import bound, oracle, sql
from .registry import registry

QUERIES, SQL, query = registry()

_SYSTEM, _SCHEMA = "Judge the text.", {"type": "object"}


@query("""WITH p AS (SELECT 'legacy' AS profile, lang AS stage, coalesce(text, '') AS t FROM documents UNION ALL SELECT 'head', lang, substr(coalesce(text, ''), 1, 1000) FROM documents),
s AS (SELECT profile, stage, ceil(length('Judge the text.' || chr(10) || '{"type":"object"}' || chr(10) || 'TEXT:' || chr(10) || t) / 4)::BIGINT AS tokens FROM p),
f AS (SELECT profile, stage, count(*) AS n, sum(tokens)::BIGINT AS total, round(avg(tokens), 6) AS mean, median(tokens) AS median, round(quantile_cont(tokens, 0.95), 6) AS p95, min(tokens) AS minimum, max(tokens) AS maximum FROM s GROUP BY ALL)
SELECT f.*, round(100.0 * (o.total - f.total) / o.total, 6) AS reduction_percent FROM f JOIN f o ON o.profile = 'legacy' AND o.stage IS NOT DISTINCT FROM f.stage""")
def prompt_tokens(spark: SparkSession, d: str) -> DataFrame:
    docs = sql(spark, d, "SELECT lang AS stage, coalesce(text, '') AS t FROM {documents}")
    prompt = lambda t: requests.prompt_text(F.lit(_SYSTEM), F.lit(requests.compact_schema(_SCHEMA)), F.lit("TEXT:"), t)
    profiles = F.array(F.struct(F.lit("legacy").alias("profile"), prompt(F.col("t")).alias("text")), F.struct(F.lit("head").alias("profile"), prompt(F.substring("t", 1, 1000)).alias("text")))
    out = composites.token_benchmark(docs.select("stage", F.explode(profiles).alias("x")).select("stage", "x.*"))
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "p95", "reduction_percent")})


@query(oracle("pairs") + """, e AS (SELECT *, CASE WHEN overlap_with <> '' AND substr(overlap_with, 2)::INT >= 50 THEN 'pattern unknown' END AS error FROM pairs)
SELECT repository, issue_number, pair_pos, error, CASE WHEN error IS NULL THEN verdict END AS verdict, CASE WHEN error IS NULL THEN mechanism_match END AS mechanism_match,
  CASE WHEN error IS NULL THEN evidence_text END AS evidence_text, CASE WHEN error IS NULL THEN overlap_with END AS overlap_with FROM e""")
def wire_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    ids = {f"P{i}": f"X{i:03}" for i in range(50)}
    none = F.array().cast("array<string>")
    over = F.when(F.col("overlap_with") != "", F.array("overlap_with")).otherwise(none)
    parts = {
        "verdict": F.col("verdict"), "mechanism_match": F.col("mechanism_match"), "scope_match": F.col("scope_match"), "focus_match": F.col("focus_match"), "evidence_text": F.col("evidence_text"), "evidence_location": F.array("evidence_location"),
        "justification": F.lit("because"), "adoption_status": F.col("adoption_status"), "false_friend_detected": F.col("false_friend_detected"), "pattern_challenge_categories": none, "confidence": F.col("confidence"), "alternative_pattern": F.lit(""), "overlap_with": over,
    }
    rows = bound(spark, d, "pairs").withColumn("value", F.struct(*[v.alias(k) for k, v in parts.items()]))
    rows = rows.withColumn("wire", responses.encode_wire(F.col("value"), 2, ids))
    text, error = responses.decode_wire(F.col("wire"), 2, ids)
    rows = rows.select(*KEY, "pair_pos", text.alias("long"), error.alias("error"))
    at = lambda n: F.when(F.col("error").isNull(), F.get_json_object("long", f"$.{n}"))
    listed = F.array_join(F.from_json(F.get_json_object("long", "$.overlap_with"), "array<string>"), "|")
    return rows.select(*KEY, "pair_pos", "error", at("verdict").alias("verdict"), at("mechanism_match").cast("boolean").alias("mechanism_match"), at("evidence_text").alias("evidence_text"), F.when(F.col("error").isNull(), listed).alias("overlap_with"))


@query("""WITH s AS (SELECT event_id, event_id % 7 AS k, event_id % 5000 AS n, event_type FROM events),
e AS (SELECT *, CASE k WHEN 0 THEN 'no answer' WHEN 1 THEN 'prompt blocked' WHEN 2 THEN 'finish is not STOP' WHEN 3 THEN 'no text' END AS error FROM s)
SELECT event_id, error, CASE WHEN error IS NULL THEN event_type END AS text, CASE k WHEN 1 THEN '' WHEN 2 THEN 'MAX_TOKENS' WHEN 0 THEN '' ELSE 'STOP' END AS stop_reason,
  CASE WHEN k IN (2, 3, 4, 6) THEN n WHEN k = 5 THEN n + 1 END::BIGINT AS input_tokens, CASE WHEN k = 5 THEN 7 END::BIGINT AS thoughts_tokens FROM e""")
def response_outcome(spark: SparkSession, d: str) -> DataFrame:
    rows = sql(spark, d, "SELECT event_id, event_id % 7 AS k, event_id % 5000 AS n, event_type AS t FROM {events}")
    chat = lambda finish, content: F.concat(F.lit('{"id":"a","choices":[{"finish_reason":' + finish + ',"message":{"content":"'), content, F.lit('"}}],"usage":{"prompt_tokens":'), F.col("n").cast("string"), F.lit("}}"))
    other = F.concat(F.lit('{"candidates":[{"finish_reason":"FinishReason.STOP","content":{"parts":[{"text":" '), F.col("t"), F.lit('"}]}}],"usage_metadata":{"prompt_token_count":'), (F.col("n") + 1).cast("string"), F.lit(',"thoughts_token_count":7}}'))
    k = F.col("k")
    answer = F.when(k == 0, F.lit("oops")).when(k == 1, F.lit('{"prompt_feedback":{"block_reason":"SAFETY"}}')).when(k == 2, chat('"length"', F.col("t"))).when(k == 3, chat('"stop"', F.lit(" "))).when(k == 5, other).when(k == 6, chat("null", F.col("t"))).otherwise(chat('"stop"', F.col("t")))
    out = rows.select("event_id", responses.outcome(answer).alias("o"))
    return out.select("event_id", "o.error", "o.text", "o.stop_reason", "o.input_tokens", "o.thoughts_tokens")


@query(oracle("pairs", "stage1") + """ SELECT DISTINCT p.repository, p.issue_number, p.pattern, p.evidence_text FROM pairs p JOIN stage1 s USING (repository, issue_number) WHERE s.request_status = 'succeeded'""")
def evidence_lookup(spark: SparkSession, d: str) -> DataFrame:
    found = dealt(bound(spark, d, "pairs"), *KEY).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("pair_pos", "pattern", "evidence_text"))).alias("a"))
    told = F.to_json(F.transform("a", lambda x: F.struct(x["pattern"].alias("pattern"), x["evidence_text"].alias("evidence_text"))))
    first = bound(spark, d, "stage1").select(*KEY, "request_status").join(found.select(*KEY, told.alias("candidate_details")), list(KEY))
    return requests.evidence_of(first)


@query(oracle("pairs") + """, g AS (SELECT repository, issue_number, pattern, min(verdict) FILTER (WHERE request_status = 'succeeded') AS g, bool_or(pair_pos <= 4) AS c, any_value(CASE substr(pattern, 2)::INT % 4 WHEN 0 THEN 'yes' WHEN 2 THEN 'uncertain' ELSE 'no' END) AS t FROM pairs GROUP BY ALL),
k AS (SELECT * FROM g WHERE t IN ('yes', 'no')), v AS (SELECT 'conditional' AS view, t, g FROM k WHERE g IN ('yes', 'no') UNION ALL SELECT 'end_to_end', t, CASE WHEN g = 'yes' THEN 'yes' ELSE 'no' END FROM k)
SELECT view, count(*) AS n, count(*) FILTER (WHERE t = 'yes' AND g = 'yes') AS tp, count(*) FILTER (WHERE t = 'no' AND g = 'no') AS tn, count(*) FILTER (WHERE t = 'no' AND g = 'yes') AS fp, count(*) FILTER (WHERE t = 'yes' AND g = 'no') AS fn,
  (SELECT round(count(*) FILTER (WHERE t = 'yes' AND c) / count(*) FILTER (WHERE t = 'yes'), 9) FROM k) AS candidate_recall FROM v GROUP BY view""")
def pair_quality(spark: SparkSession, d: str) -> DataFrame:
    pairs = bound(spark, d, "pairs")
    number = F.substring("pattern", 2, 20).cast("int") % 4
    labels = pairs.select(*PAIR_KEY, F.when(number == 0, "yes").when(number == 2, "uncertain").otherwise("no").alias("human_verdict")).distinct()
    results = pairs.where("request_status = 'succeeded'").groupBy(*PAIR_KEY).agg(F.min("verdict").alias("verdict"))
    out = metrics.pair_quality(labels, pairs.where("pair_pos <= 4"), results, PAIR_KEY)
    return out.select("view", "n", "tp", "tn", "fp", "fn", F.round("candidate_recall", 9).alias("candidate_recall"))


_REASONS = "CASE WHEN n_chars % 5 = 0 THEN 'lexical' END, CASE WHEN n_chars % 3 = 0 THEN 'semantic_minimum' END, CASE WHEN n_chars % 4 = 0 THEN 'family_expansion' END"


@query(oracle("labelled") + """, r AS (SELECT lang, n_chars % 5 = 0 AS l, n_chars % 3 = 0 AS s, n_chars % 4 = 0 AS f FROM labelled WHERE labelled)
SELECT lang, count(*) AS pairs, count(*) FILTER (WHERE l OR s OR f) AS hits, count(*) FILTER (WHERE s AND NOT l) AS semantic_only, count(*) FILTER (WHERE f AND NOT l AND NOT s) AS family_only, count(*) FILTER (WHERE l) AS lexical,
  round(count(*) FILTER (WHERE l OR s OR f) / count(*), 9) AS recall, round(count(*) FILTER (WHERE l) / count(*), 9) AS lexical_rate FROM r GROUP BY lang""")
def recovery_by_mechanism(spark: SparkSession, d: str) -> DataFrame:
    due = bound(spark, d, "labelled").where("labelled").select("lang", F.expr(f"filter(array({_REASONS}), x -> x IS NOT NULL)").alias("reasons"))
    return metrics.recovery(due, ["lang"]).withColumns({c: F.round(c, 9) for c in ("recall", "lexical_rate")})


@query(oracle("labelled") + """, c AS (SELECT l.doc_id, CASE WHEN human IS NULL THEN 'EXCLUDED_HUMAN_MISSING' WHEN human NOT IN ('yes', 'no') THEN 'EXCLUDED_HUMAN_' || upper(human) WHEN human = 'yes' THEN CASE WHEN baseline = 'yes' THEN 'TP' ELSE 'FN' END WHEN baseline = 'yes' THEN 'FP' ELSE 'TN' END AS classification, b.item_id FROM labelled l LEFT JOIN benchmark b ON b.item_id = l.doc_id)
SELECT classification, CASE WHEN classification IN ('FP', 'FN') THEN CASE WHEN item_id IS NULL THEN 'needs_human_review' ELSE 'passage ' || item_id END ELSE '' END AS diagnosis, count(*) AS n FROM c GROUP BY ALL""")
def diagnosis_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = bound(spark, d, "labelled").select("doc_id", metrics.classification(F.col("human"), F.col("baseline")).alias("classification"))
    notes = sql(spark, d, "SELECT item_id AS doc_id, concat('passage ', item_id) AS diagnosis FROM {benchmark}")
    return metrics.with_diagnosis(rows, "doc_id", "classification", notes).groupBy("classification", "diagnosis").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT 'shop' AS repository, concat('', o_orderkey) AS issue_number, o_orderkey % 3 AS k, concat('Kind ', o_custkey % 7) AS a, concat('Kind ', (o_custkey + 1) % 9) AS b FROM orders)
SELECT repository, issue_number, a AS pattern, 0 AS candidate_pos FROM o WHERE k < 2 UNION ALL SELECT repository, issue_number, CASE b WHEN 'Kind 8' THEN 'kind-8' ELSE b END, 1 FROM o WHERE k = 1 AND b <> a""")
def lenient_pairs(spark: SparkSession, d: str) -> DataFrame:
    cells = sql(spark, d, """SELECT 'shop' AS repository, concat('', o_orderkey) AS issue_number, 'errored' AS request_status, CASE o_orderkey % 3 WHEN 0 THEN concat('["kind_', o_custkey % 7, '", " KIND ', o_custkey % 7, ' "]')
      WHEN 1 THEN concat('Kind-', o_custkey % 7, '|kind-', (o_custkey + 1) % 9) ELSE '[broken' END AS candidates FROM {orders}""")
    return stages.explode_pairs(cells, strict=False, names=[f"Kind {i}" for i in range(8)])


@query("SELECT concat('', conv_id) AS conv_id, concat('', turn) AS turn, coalesce(role, '') AS role, md5(coalesce(text, '')) AS text_md5 FROM conversations")
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "csv")
    sinks.write_csv(sql(spark, d, "SELECT conv_id AS `Conv ID`, turn AS `Turn`, role AS ` role `, text AS `Text` FROM {conversations}").coalesce(1), path)
    return files.read_csv(spark, path).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("""WITH a AS (SELECT concat('s', n_nationkey) AS name, concat('', n_regionkey) AS l FROM nation), b AS (SELECT concat('s', n_nationkey + 2) AS name, concat('', CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey ELSE 9 END) AS r FROM nation)
SELECT 'differs' AS rule, name FROM a FULL JOIN b USING (name) WHERE l IS DISTINCT FROM r UNION ALL SELECT 'resume', name FROM a LEFT JOIN b USING (name) WHERE replace(l, '4', '9') IS DISTINCT FROM r
UNION ALL SELECT 'left', name FROM a ANTI JOIN b USING (name) UNION ALL SELECT 'right', name FROM b ANTI JOIN a USING (name)""")
def settings_conflicts(spark: SparkSession, d: str) -> DataFrame:
    a = sql(spark, d, "SELECT concat('s', n_nationkey) AS name, concat('', n_regionkey) AS value FROM {nation}")
    b = sql(spark, d, "SELECT concat('s', n_nationkey + 2) AS name, concat('', CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey ELSE 9 END) AS value FROM {nation}")
    sides = audit.key_difference(a, b, ["name"]).select(F.col("side").alias("rule"), "name")
    differ, resume = audit.differing_settings(a, b), audit.resume_conflicts(a, b, {"4": "9"})
    return differ.select(F.lit("differs").alias("rule"), "name").unionByName(resume.select(F.lit("resume").alias("rule"), "name")).unionByName(sides)


@query(oracle("pairs") + """ SELECT repository, issue_number, pair_pos, array_to_string(list_filter([CASE WHEN verdict NOT IN ('yes', 'no', 'uncertain') THEN '$.verdict: not allowed' END, CASE WHEN adoption_status = '' THEN '$.status: missing' END,
  CASE WHEN overlap_with <> '' THEN '$: unknown keys' END], lambda x: x IS NOT NULL), '|') AS broken FROM pairs""")
def schema_violations(spark: SparkSession, d: str) -> DataFrame:
    schema = {"type": "object", "additionalProperties": False, "required": ["verdict", "status"], "properties": {"verdict": {"type": "string", "enum": ["yes", "no", "uncertain"]}, "status": {"type": "string"}}}
    rows = bound(spark, d, "pairs")
    text = F.to_json(F.struct("verdict", F.nullif(F.col("adoption_status"), F.lit("")).alias("status"), F.nullif(F.col("overlap_with"), F.lit("")).alias("extra")))
    order = F.array(*[F.lit(x) for x in ("$.verdict: not allowed", "$.status: missing", "$: unknown keys")])
    found = responses.schema_errors(responses.json_object(F.concat(F.lit("```json\n"), text, F.lit("\n```"))), schema)
    return rows.select(*KEY, "pair_pos", once(found, lambda f: F.array_join(F.filter(order, lambda x: F.array_contains(f, x)), "|")).alias("broken"))


@query("""SELECT 'Shop' AS repository, concat('', c_custkey) AS issue_number, trim(c_name) AS issue_title, c_mktsegment || chr(10) || 'x' AS issue_body, concat('Shop#', c_custkey) AS issue_key, '' AS labels, concat('', c_nationkey) AS nation FROM customer""")
def cleaned_input(spark: SparkSession, d: str) -> DataFrame:
    raw = sql(spark, d, "SELECT ' Shop ' AS `Repository`, 'Shop' AS `repository full name`, concat(c_custkey, '.0') AS `Issue  Number`, concat('  ', c_name, ' ') AS `ISSUE-TITLE`, concat(c_mktsegment, chr(13), chr(10), 'x ') AS issue_body, concat(' ', c_nationkey) AS `Nation` FROM {customer}")
    return validate_input(raw, ascii_only=True).select(*KEY, "issue_title", "issue_body", "issue_key", "labels", "nation")


@query("""SELECT c_custkey, c_mktsegment AS first, 'seg ' || c_nationkey AS second, CASE WHEN c_nationkey % 2 = 0 THEN 'pull_request_description|title' ELSE 'body|title' END AS locations, CASE WHEN c_custkey % 3 = 0 THEN 'Q4_K_M' WHEN c_custkey % 3 = 1 THEN 'F16' ELSE '' END AS quantization,
  CASE WHEN c_nationkey = 0 THEN 'n/a' ELSE c_nationkey || '.00%' END AS share FROM customer""")
def cell_rules(spark: SparkSession, d: str) -> DataFrame:
    rows = sql(spark, d, """SELECT c_custkey, concat('A1: ', c_mktsegment, '; A2: seg ', c_nationkey) AS cell, CASE WHEN c_nationkey % 2 = 0 THEN 'Pull Request' ELSE 'issue' END AS type,
      CASE c_custkey % 3 WHEN 0 THEN '/m/tiny-7b.q4_k_m.gguf' WHEN 1 THEN 'base-f16.bin' ELSE 'plain.bin' END AS path, CASE WHEN c_nationkey > 0 THEN c_nationkey / 100.0D END AS share FROM {customer}""")
    where = rules.remap_locations(F.array(F.lit("body"), F.lit("title")), F.col("type"), loose=True)
    return rows.select("c_custkey", part_of(F.col("cell"), "A1").alias("first"), part_of(F.col("cell"), "A2").alias("second"), F.array_join(where, "|").alias("locations"), quantization(F.col("path")).alias("quantization"), percent(F.col("share")).alias("share"))


@query("""SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN NULL WHEN greatest(s, r) <= 0 THEN 'paraphrase_not_captured' WHEN s >= 0.3 THEN 'other' WHEN p_size % 4 = 0 THEN 'missing_family_relation' WHEN s >= 0.15 THEN 'threshold_too_high' ELSE 'semantic_model_failure' END AS kind
FROM (SELECT *, p_size / 100 AS s, (p_size - 20) / 100 AS r FROM (SELECT p_partkey, p_size - 10 AS p_size FROM part))""")
def miss_kinds(spark: SparkSession, d: str) -> DataFrame:
    rows = sql(spark, d, "SELECT p_partkey, p_size - 10 AS n FROM {part}")
    n = F.col("n")
    return rows.select("p_partkey", retrieval.miss_kind(n / 100, (n - 20) / 100, n % 6 == 0, 0.3, n % 4 == 0).alias("kind"))


@query(oracle("calls") + """ SELECT logical_request_id AS id, CASE WHEN bool_or(response_status = 'succeeded') THEN 'completed' ELSE 'failed' END AS state FROM calls GROUP BY 1""")
def request_progress(spark: SparkSession, d: str) -> DataFrame:
    return stages.progress(bound(spark, d, "calls").withColumnRenamed("response_status", "request_status"), "logical_request_id")


@query("""WITH e AS (SELECT label, embedding AS v FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
s AS (SELECT q.vec_id // 10 AS grp, q.vec_id % 10 AS chunk, e.label AS name, round(round(greatest(-1, least(1, list_dot_product(q.embedding::DOUBLE[], e.v::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.v::DOUBLE[], e.v::DOUBLE[]))))), 8), 6) AS score FROM embeddings q, e)
SELECT grp, name, max(score) AS score FROM s GROUP BY ALL""")
def dense_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = sql(spark, d, "SELECT vec_id, vec_id DIV 10 AS grp, vec_id % 10 AS chunk, embedding, label FROM {embeddings}")
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("e")).withColumnRenamed("label", "name")
    out = retrieval.dense_cosines(rows, "grp", "embedding", first, "name", "e")
    return out.select("grp", "name", F.round("score", 6).alias("score"))


def _evaluated(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    pairs = dealt(bound(spark, d, "pairs"), *KEY)
    number = F.substring("pattern", 2, 20).cast("int") % 4
    results = pairs.groupBy(*PAIR_KEY).agg(F.min("verdict").alias("verdict"))
    labels = results.select(*PAIR_KEY, F.when(number == 0, "yes").when(number == 1, "no").otherwise("uncertain").alias("human_verdict")).where(number < 3)
    inferred = results.where(number >= 2).select(*PAIR_KEY, F.lit("no").alias("human_verdict"))
    cells = pairs.where("pair_pos <= 3").groupBy(*KEY).agg(F.to_json(F.collect_set("pattern")).alias("candidates"))
    first = bound(spark, d, "stage1").select(*KEY).join(cells, list(KEY), "left").withColumn("candidates", F.coalesce("candidates", F.lit("[]")))
    return composites.evaluate_pairs(labels, first, results, inferred)


_EVALUATED = oracle("pairs", "stage1") + """, r AS (SELECT repository, issue_number, pattern, min(verdict) AS verdict, bool_or(pair_pos <= 3) AS c, substr(pattern, 2)::INT % 4 AS k FROM pairs GROUP BY ALL),
l AS (SELECT *, CASE k WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'uncertain' ELSE 'no' END AS human FROM r)"""


@query(_EVALUATED + """ SELECT count(*) FILTER (WHERE human IN ('yes', 'uncertain')) AS positives, count(*) FILTER (WHERE human IN ('yes', 'uncertain') AND c) AS hits,
  round(count(*) FILTER (WHERE human IN ('yes', 'uncertain') AND c) / count(*) FILTER (WHERE human IN ('yes', 'uncertain')), 9) AS recall, count(*) FILTER (WHERE human IN ('yes', 'uncertain') AND NOT c) AS false_negatives FROM l""")
def pair_evaluation_recall(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d)["stage1"].withColumn("recall", F.round("recall", 9))


@query(_EVALUATED + """ SELECT human AS human_verdict, count(*) FILTER (WHERE verdict = 'insufficient_context') AS insufficient_context, count(*) FILTER (WHERE verdict = 'no') AS no, count(*) FILTER (WHERE verdict = 'uncertain') AS uncertain, count(*) FILTER (WHERE verdict = 'yes') AS yes FROM l GROUP BY 1""")
def pair_evaluation_confusion(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d)["confusion"]


@query(oracle("labelled") + """ SELECT CASE WHEN human NOT IN ('yes', 'no') THEN 'EXCLUDED_HUMAN_' || upper(human) WHEN optimized NOT IN ('yes', 'no') THEN 'EXCLUDED_PREDICTION_' || upper(optimized) WHEN human = 'yes' THEN CASE WHEN optimized = 'yes' THEN 'TP' ELSE 'FN' END WHEN optimized = 'yes' THEN 'FP' ELSE 'TN' END AS classification,
  count(*) AS "count" FROM labelled WHERE labelled GROUP BY 1""")
def issue_evaluation(spark: SparkSession, d: str) -> DataFrame:
    rows = bound(spark, d, "labelled").where("labelled")
    human = rows.select(*KEY, F.col("human").alias("human_relevance"))
    return composites.evaluate_issues(human, rows.select(*KEY, F.col("optimized").alias("relevant_to_pattern_study")))["labels"]


@query("""SELECT concat('', doc_id) AS issue_number, CASE WHEN n < 1000 THEN 'no' WHEN n % 3 = 0 THEN 'yes' WHEN n % 3 = 1 THEN 'uncertain' ELSE 'no' END AS relevant_to_pattern_study, CASE WHEN n >= 1000 AND n % 3 = 0 THEN 'Alpha' ELSE '' END AS patterns_confirmed
FROM (SELECT doc_id, coalesce(n_chars, 0) AS n FROM documents)""")
def replayed_run(spark: SparkSession, d: str) -> DataFrame:
    """A whole run over all documents as issues, on stored answers of both stages."""
    docs = sql(spark, d, "SELECT 'corpus' AS repository, concat('', doc_id) AS issue_number, concat('t', doc_id) AS issue_title, coalesce(text, '') AS issue_body, coalesce(n_chars, 0) AS n FROM {documents}")
    one = '{"issue_summary":"s","issue_activity_type":"other","issue_challenge_categories":[],"context_status":"sufficient","candidates":%s}'
    found = '[{"pattern":"Alpha","evidence_text":"e","evidence_location":"body","rationale":"r","confidence":"high"}]'
    first = docs.select(stable_id("s1", F.col("repository"), F.col("issue_number")).alias("custom_id"), F.lit(0).alias("pos"), F.when(F.col("n") >= 1000, one % found).otherwise(one % "[]").alias("response"))
    two = '{"verdict":"%s","evidence_text":"e","evidence_location":["body"],"justification":"j","adoption_status":"%s","false_friend_detected":"no","pattern_challenge_categories":[],"confidence":"high","alternative_pattern":"","overlap_with":[]}'
    r = F.col("n") % 3
    verdict = F.when(r == 0, two % ("yes", "implemented_existing")).when(r == 1, two % ("uncertain", "proposed_or_planned")).otherwise(two % ("no", "not_related"))
    second = docs.select(stable_id("s2", F.col("repository"), F.col("issue_number"), F.lit("Alpha")).alias("custom_id"), F.lit(0).alias("pos"), verdict.alias("response"))
    out = composites.run(docs.drop("n"), ["Alpha", "Beta"], composites.replay(first), composites.replay(second))
    return out["issues"].select("issue_number", "relevant_to_pattern_study", "patterns_confirmed")


@query()
def optimized_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts of the optimised profile for all documents, against the benchmark passages as a catalog."""
    entries = sql(spark, d, "SELECT concat('N', lpad(item_id, 6, '0')) AS pattern, concat('X', item_id) AS pattern_id, text AS short_definition FROM {benchmark}")
    docs = sql(spark, d, "SELECT 'corpus' AS repository, concat('', doc_id) AS issue_number, substring_index(coalesce(text, ''), ' ', 6) AS issue_title, coalesce(text, '') AS issue_body FROM {documents}")
    words = F.split("short_definition", " ")
    phrases = entries.select("pattern", F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1))).alias("phrase"), F.lit(True).alias("direct"))
    model = retrieval.fit_latent(entries, "pattern", "short_definition")
    out = requests.prepare_optimized(docs, requests.Entries.of(entries), phrases, [], model, retrieval.Config(confidence=0.3, fall_back_to_all=False), tokens=600)
    return out.select("issue_number", F.size("candidates").alias("candidates"), "included_char_count", "input_truncated", "context_error", F.sha2("artifact_text", 256).alias("artifact_sha256"))
