"""Queries of text cleaning, preparation and response handling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import audit, catalog, prepare, responses, retrieval, vocab
from .bindings import sql, table
from .registry import registry

QUERIES, SQL, query = registry()
WS = r"[ \t\n\r\f\v]"


@query("SELECT source, sum(ceil(length(text) / 4.0))::BIGINT AS baseline, sum(ceil(least(length(text), 2000) / 4.0))::BIGINT AS optimized, round(100.0 * (sum(ceil(length(text) / 4.0)) - sum(ceil(least(length(text), 2000) / 4.0))) / sum(ceil(length(text) / 4.0)), 6) AS saved_percent FROM documents GROUP BY source")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    rows = sql(spark, d, "SELECT source, text FROM {documents}")
    out = rows.groupBy("source").agg(F.sum(text.estimated_tokens(F.col("text"))).alias("baseline"), F.sum(text.estimated_tokens(F.substring("text", 1, 2000))).alias("optimized"))
    return out.withColumn("saved_percent", F.round(F.try_divide(100.0 * (F.col("baseline") - F.col("optimized")), F.col("baseline")), 6))


@query("SELECT doc_id, 's1_' || substr(sha256(source || chr(31) || doc_id), 1, 32) AS custom_id, sha256(text) AS text_sha256 FROM documents")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = sql(spark, d, "SELECT doc_id, source, text FROM {documents}")
    return rows.select("doc_id", text.stable_id("s1", F.col("source"), F.col("doc_id").cast("string")).alias("custom_id"), F.sha2("text", 256).alias("text_sha256"))


def _cut_sql(s: str, budget: str) -> str:
    """DuckDB text of head_tail for a stripped text and a budget."""
    note = f"(chr(10) || '[... ' || (length({s}) - {budget}) || ' caracteres omitidos ...]' || chr(10))"
    usable = f"greatest(1, {budget} - length({note}))"
    head = f"ceil({usable} * 0.65::DOUBLE)::INT"
    return f"""CASE WHEN length({s}) <= {budget} THEN {s} WHEN {budget} <= 80 THEN left({s}, {budget}) ELSE regexp_replace(left({s}, {head}), '\\s+$', '') || {note} || regexp_replace(right({s}, {usable} - {head}), '^\\s+', '') END"""


@query("WITH s AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents) SELECT doc_id, sha256(" + _cut_sql("t", "500") + ") AS cut_sha256, length(t) > 500 AS was_cut FROM s")
def head_tail_truncate(spark: SparkSession, d: str) -> DataFrame:
    cut, was = text.head_tail(F.col("text"), 500)
    return sql(spark, d, "SELECT doc_id, text FROM {documents}").select("doc_id", F.sha2(cut, 256).alias("cut_sha256"), was.alias("was_cut"))


ISSUES = """SELECT d.source AS repository, concat('', d.doc_id) AS issue_number, split_part(d.text, chr(10), 1) AS issue_title, d.text AS issue_body, coalesce(c.talk, '') AS concatenated_comments, d.lang AS labels, '' AS state, 'Issue' AS type
FROM {documents} d LEFT JOIN {talks} c ON c.conv_id = d.doc_id"""


def issues(spark: SparkSession, d: str) -> DataFrame:
    """Documents as issues, with the conversation of the same number as comments."""
    turns = sql(spark, d, "SELECT conv_id, turn, text FROM {conversations}")
    talks = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("talk"))
    return spark.sql(ISSUES, documents=table(spark, d, "documents"), talks=talks)


_STRIP = lambda c: f"regexp_replace(regexp_replace({c}, '[^\\P{{Cc}}\\n\\t]', '', 'g'), '^\\s+|\\s+$', '', 'g')"


@query(
    "WITH talks AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS talk FROM conversations GROUP BY conv_id), i AS (" + ISSUES.replace("{", "").replace("}", "") + "),"
    + f"""c AS (SELECT repository, issue_number, labels, {_STRIP('issue_title')} AS title, {_STRIP('issue_body')} AS body, {_STRIP('concatenated_comments')} AS talk FROM i),
f AS (SELECT *, '<repository>' || repository || '</repository>' || chr(10) || '<issue_number>' || issue_number || '</issue_number>' || chr(10) || '<artifact_type>Issue</artifact_type>' || chr(10) || '<state></state>' || chr(10)
  || '<labels>' || labels || '</labels>' || chr(10) || '<title>' || title || '</title>' || chr(10) AS fixed FROM c),
b AS (SELECT *, greatest(200, 3000 - length(fixed) - 35) AS room FROM f), w AS (SELECT *, greatest(100, floor(room * CASE WHEN talk = '' THEN 1.0 ELSE 0.65 END::DOUBLE)::INT) AS bb FROM b), x AS (SELECT *, greatest(0, room - bb) AS cb FROM w),
o AS (SELECT *, {_cut_sql('body', 'bb')} AS b1, CASE WHEN cb > 0 THEN {_cut_sql('talk', 'cb')} ELSE '' END AS c1 FROM x),
a AS (SELECT *, fixed || '<body>' || b1 || '</body>' || chr(10) || '<comments>' || c1 || '</comments>' AS artifact FROM o)
SELECT repository || '#' || issue_number AS issue_key, 's1_' || substr(sha256(repository || chr(31) || issue_number), 1, 32) AS custom_id, sha256(artifact) AS artifact_sha256,
  (length(title) + length(body) + length(talk) + 5 + length(labels))::BIGINT AS original_char_count, length(artifact) AS included_char_count, length(body) > bb OR (cb > 0 AND length(talk) > cb) AS input_truncated FROM a"""
)
def prepare_issue(spark: SparkSession, d: str) -> DataFrame:
    out = prepare.prepare(issues(spark, d), 3000)
    return out.select("issue_key", "custom_id", F.sha2("artifact_text", 256).alias("artifact_sha256"), "original_char_count", "included_char_count", "input_truncated")


@query(r"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '[^\x00-\x7F]+', '', 'g'), '\r\n?', chr(10), 'g'), '[\x00-\x08\x0B-\x1F\x7F]', '', 'g'), '\s+', ' ', 'g'))) AS clean_sha256 FROM pages")
def clean_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = sql(spark, d, "SELECT page_id, html FROM {pages}")
    return rows.select("page_id", F.sha2(text.clean_token(F.regexp_replace("html", r"[^\x00-\x7F]+", ""), True), 256).alias("clean_sha256"))


@query()
def normalize_unicode(spark: SparkSession, d: str) -> DataFrame:
    return sql(spark, d, "SELECT doc_id, text FROM {documents}").select("doc_id", F.sha2(text.clean_text(F.col("text")), 256).alias("clean_sha256"))


FP = "trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"WITH n AS (SELECT DISTINCT p_type AS canonical, {FP.format(c='p_type')} AS fp FROM part), q AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_type || ' X' ELSE replace(upper(p_type), ' ', '_-') END AS given FROM part) SELECT p_partkey, n.canonical, n.fp IS NOT NULL AS known FROM q LEFT JOIN n ON n.fp = {FP.format(c='q.given')}")
def fingerprint_join(spark: SparkSession, d: str) -> DataFrame:
    rows = sql(spark, d, "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN concat(p_type, ' X') ELSE replace(upper(p_type), ' ', '_-') END AS given FROM {part}")
    return vocab.canonicalize(rows, "given", sql(spark, d, "SELECT DISTINCT p_type FROM {part}"), "p_type", ascii_only=True).select("p_partkey", "canonical", "known")


@query("""WITH q AS (SELECT p_partkey, string_split(p_brand || ' | ' || p_type || '||' || p_brand || '|none', '|') AS a FROM part), e AS (SELECT p_partkey, unnest(a) AS v, generate_subscripts(a, 1) AS pos FROM q),
c AS (SELECT p_partkey, trim(v) AS v, min(pos) AS pos FROM e WHERE trim(v) <> '' GROUP BY ALL) SELECT p_partkey, string_agg(v, ';' ORDER BY pos) AS "values" FROM c WHERE v <> 'none' GROUP BY p_partkey""")
def multivalue_split(spark: SparkSession, d: str) -> DataFrame:
    rows = sql(spark, d, "SELECT p_partkey, concat(p_brand, ' | ', p_type, '||', p_brand, '|none') AS cell FROM {part}")
    names = sql(spark, d, "SELECT DISTINCT p_brand AS canonical FROM {part} UNION SELECT DISTINCT p_type FROM {part}")
    return vocab.canonicalize_multivalue(rows, ["p_partkey"], "cell", names, ascii_only=True).select("p_partkey", F.array_join("values", ";").alias("values"))


@query("""WITH c AS (SELECT unnest(['number', 'text']) AS reason, unnest(['id', 'body']) AS scope_, unnest([doc_id || '.0', text]) AS b, unnest([concat('', doc_id), regexp_replace(text, '^\\s+|\\s+$', '', 'g')]) AS a FROM documents),
x AS (SELECT reason FROM c WHERE coalesce(a, '') <> coalesce(b, '')) SELECT 'reason' AS "by", reason AS value, count(*) AS changes FROM x GROUP BY reason UNION ALL SELECT 'scope', 'documents', count(*) FROM x""")
def change_audit(spark: SparkSession, d: str) -> DataFrame:
    rows = sql(spark, d, "SELECT doc_id, concat(doc_id, '.0') AS number, text FROM {documents}")
    after = {"number": (text.issue_number(F.col("number"), True), "number"), "text": (text.strip(F.col("text")), "text")}
    return audit.change_summary(audit.changes(rows, after, ["doc_id"], "documents"))


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''")
def literal_evidence(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.literal_passages(sql(spark, d, "SELECT doc_id, text FROM {documents}"), "doc_id", "text", sql(spark, d, "SELECT item_id, text AS passage FROM {benchmark}"), "item_id", "passage")


PHRASES = "SELECT item_id, concat_ws(' ', split_part(text, ' ', 2), split_part(text, ' ', 3)) AS phrase FROM {benchmark}"


@query("WITH p AS (SELECT item_id, trim(regexp_replace(phrase, '[^A-Za-z ]', '', 'g')) AS phrase FROM (" + PHRASES.replace("{", "").replace("}", "") + ")), t AS (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g') AS text FROM documents) SELECT DISTINCT doc_id, phrase FROM t JOIN p ON regexp_matches(t.text, '(?i)(^|[^A-Za-z0-9_])' || phrase || '([^A-Za-z0-9_]|$)') WHERE phrase <> ''")
def phrase_match(spark: SparkSession, d: str) -> DataFrame:
    words = sql(spark, d, PHRASES).select(F.concat(F.lit("i"), "item_id").alias("pattern"), F.trim(F.regexp_replace("phrase", "[^A-Za-z ]", "")).alias("phrase"), F.lit(True).alias("direct")).where("phrase <> ''")
    docs = sql(spark, d, "SELECT doc_id, text FROM {documents}").withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "_"))
    return retrieval.lexical_matches(docs, "doc_id", "text", words, unicode=False).select("doc_id", "phrase").distinct()


FRIENDS = [("en", r"(?i)\b(?:card|phone)\b|[0-9]{12,}", "number"), ("en", r"(?i)\blicensed under\b", "licence"), ("de", r"(?i)\b(?:email|mail)[a-z]*\b|@", "address"), ("fr", r"(?i)password=|token =", "secret")]


@query("WITH r(pattern, regex, reason) AS (VALUES " + ", ".join(f"('{p}', '{x}', '{y}')" for p, x, y in FRIENDS) + ") SELECT d.doc_id, r.pattern, r.reason FROM documents d JOIN r ON r.pattern = d.lang AND regexp_matches(d.text, r.regex)")
def false_friend_rules(spark: SparkSession, d: str) -> DataFrame:
    docs = sql(spark, d, "SELECT doc_id, text, lang AS pattern FROM {documents}")
    table = spark.createDataFrame(FRIENDS, "pattern string, regex string, reason string")
    return retrieval.false_friends(docs, "doc_id", "text", docs, table)


@query("""WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'Insufficient-Context' ELSE 'maybe' END AS v, CASE event_id % 3 WHEN 0 THEN 'superficial mention' ELSE 'Implemented_Existing' END AS s,
  CASE WHEN event_id % 5 = 0 THEN '' ELSE 'because' END AS j, event_id % 7 <> 0 AS m, event_id % 11 = 0 AS bad FROM events),
n AS (SELECT *, CASE v WHEN 'Insufficient-Context' THEN 'insufficient_context' WHEN 'maybe' THEN NULL ELSE v END AS v1, lower(replace(s, ' ', '_')) AS s1 FROM e),
d AS (SELECT *, v1 = 'yes' AND NOT m AS down, CASE WHEN v1 = 'yes' AND NOT m THEN 'uncertain' ELSE v1 END AS v2, CASE WHEN v1 = 'yes' AND NOT m AND s1 = 'superficial_mention' THEN 'conceptual_discussion' ELSE s1 END AS s2 FROM n),
x AS (SELECT *, CASE WHEN bad THEN 'no JSON object' WHEN v1 IS NULL THEN 'verdict unknown' WHEN j = '' THEN 'justification blank' WHEN v2 = 'yes' AND s2 = 'superficial_mention' THEN 'yes against adoption_status'
  WHEN v2 = 'no' AND s2 <> 'superficial_mention' THEN 'no against adoption_status' WHEN v2 = 'insufficient_context' THEN 'insufficient_context against adoption_status' END AS error FROM d)
SELECT event_id, error, CASE WHEN error IS NULL THEN v2 END AS verdict, CASE WHEN error IS NULL THEN s2 END AS adoption_status, CASE WHEN error IS NULL THEN CASE WHEN v2 = 'no' THEN '' ELSE 'other' END END AS challenges FROM x""")
def response_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = sql(spark, d, """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'Insufficient-Context' ELSE 'maybe' END AS v,
      CASE event_id % 3 WHEN 0 THEN 'superficial mention' ELSE 'Implemented_Existing' END AS s, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'because' END AS j, event_id % 7 <> 0 AS m FROM {events}""")
    payload = F.to_json(F.struct(
        F.col("v").alias("verdict"), F.col("m").alias("mechanism_match"), F.lit(" seen  here ").alias("evidence_text"), F.array(F.lit("Body")).alias("evidence_location"), F.col("j").alias("justification"), F.col("s").alias("adoption_status"),
        F.lit("no").alias("false_friend_detected"), F.array(F.lit("none explicit"), F.lit("Other")).alias("pattern_challenge_categories"), F.lit("HIGH").alias("confidence"), F.lit("").alias("alternative_pattern"), F.array(F.lit("p one")).alias("overlap_with")))
    raw = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("sorry "), payload)).otherwise(F.concat(F.lit("```json\n"), payload, F.lit("\n```")))
    out = responses.normalize_stage2(rows.select("event_id", raw.alias("raw")), "raw", ["P-One"])
    v = F.col("value")
    return out.select("event_id", "error", v["verdict"].alias("verdict"), v["adoption_status"].alias("adoption_status"), F.array_join(v["pattern_challenge_categories"], "|").alias("challenges"))


@query()
def related_patterns(spark: SparkSession, d: str) -> DataFrame:
    rows = sql(spark, d, "SELECT p_name AS name, p_brand AS category, p_type AS subcategory, p_partkey AS o FROM {part}")
    return catalog.related(rows, "name", "category", "subcategory", "o")


SQL["related_patterns"] = """SELECT p_name AS name, string_agg(related, '|' ORDER BY o, related) AS related FROM
  (SELECT DISTINCT a.p_name, b.p_name AS related, b.p_partkey AS o FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_name <> b.p_name) GROUP BY p_name"""


@query(r"WITH u AS (SELECT page_id, regexp_replace(regexp_replace(trim(url) || CASE page_id % 3 WHEN 0 THEN '/v1/' WHEN 1 THEN '//' ELSE '' END, '/+$', ''), '/v1$', '') AS u FROM pages) SELECT page_id, CASE WHEN regexp_matches(u, '^https?://[^/@]+(/[^@]*)?$') THEN u END AS base_url FROM u")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = sql(spark, d, "SELECT page_id, concat(url, CASE page_id % 3 WHEN 0 THEN '/v1/' WHEN 1 THEN '//' ELSE '' END) AS url FROM {pages}")
    return rows.select("page_id", text.base_url(F.col("url")).alias("base_url"))


ERRORS = "CASE event_id % 6 WHEN 0 THEN 'HTTP 429: Rate limit' WHEN 1 THEN 'Connection reset' WHEN 2 THEN 'Permission denied (timeout)' WHEN 3 THEN 'quota gone' WHEN 4 THEN 'bad value' ELSE concat('error 50', event_id % 5) END"


@query(f"""WITH e AS (SELECT lower({ERRORS}) AS t FROM events) SELECT t AS error, NOT regexp_matches(t, 'unauthenticated|invalid api key|permission denied|forbidden|invalid argument|bad request| 40[013]')
  AND regexp_matches(t, 'rate limit|too many requests|resource_exhausted|timed out|timeout|network|connection|temporar|unavailable| 429| 50[0234]') AS retryable, regexp_matches(t, 'quota|rate limit|too many requests|resource_exhausted|forbidden|permission denied') AS global_error, count(*) AS n FROM e GROUP BY ALL""")
def error_classification(spark: SparkSession, d: str) -> DataFrame:
    rows = sql(spark, d, "SELECT lower(" + ERRORS + ") AS error FROM {events}")
    return rows.select("error", rules.retryable(F.col("error")).alias("retryable"), rules.global_error(F.col("error")).alias("global_error")).groupBy("error", "retryable", "global_error").agg(F.count("*").alias("n"))
