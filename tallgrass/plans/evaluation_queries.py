"""Queries that hold predictions against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, metrics
from .bindings import bound, oracle, sql
from .registry import registry

QUERIES, SQL, query = registry()

COUNTS = """count(*) AS n, count(*) FILTER (WHERE human = 'yes' AND {g} = 'yes') AS tp, count(*) FILTER (WHERE human = 'no' AND {g} = 'no') AS tn,
  count(*) FILTER (WHERE human = 'no' AND {g} = 'yes') AS fp, count(*) FILTER (WHERE human = 'yes' AND {g} = 'no') AS fn"""
RATES = """round((tp + tn) / n, 9) AS accuracy, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(tn / nullif(tn + fp, 0), 9) AS specificity,
  round(fp / nullif(fp + tn, 0), 9) AS false_positive_rate, round(fn / nullif(fn + tp, 0), 9) AS false_negative_rate, round(tn / nullif(tn + fn, 0), 9) AS negative_predictive_value,
  round(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif((tp / nullif(tp + fp, 0)) + (tp / nullif(tp + fn, 0)), 0), 9) AS f1,
  round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 9) AS balanced_accuracy"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


@query(oracle("labelled") + f", c AS (SELECT lang, {COUNTS.format(g='baseline')} FROM labelled WHERE human IN ('yes', 'no') AND baseline IN ('yes', 'no') GROUP BY lang) SELECT *, {RATES} FROM c")
def binary_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.binary_metrics(bound(spark, d, "labelled"), "human", "baseline", ["lang"]))


CLASS = """CASE WHEN human IS NULL THEN 'EXCLUDED_HUMAN_MISSING' WHEN human NOT IN ('yes', 'no') THEN 'EXCLUDED_HUMAN_' || upper(human)
  WHEN {g} NOT IN ('yes', 'no') THEN 'EXCLUDED_PREDICTION_' || upper({g}) WHEN human = 'yes' THEN CASE WHEN {g} = 'yes' THEN 'TP' ELSE 'FN' END WHEN {g} = 'yes' THEN 'FP' ELSE 'TN' END"""


@query(oracle("labelled") + f" SELECT doc_id, human, optimized, {CLASS.format(g='optimized')} AS classification FROM labelled WHERE labelled")
def issue_classification(spark: SparkSession, d: str) -> DataFrame:
    rows = bound(spark, d, "labelled").where("labelled")
    return rows.select("doc_id", "human", "optimized", metrics.classification(F.col("human"), F.col("optimized")).alias("classification"))


@query(oracle("labelled") + " SELECT coalesce(human, 'missing') AS human, count(*) FILTER (WHERE optimized = 'yes') AS yes, count(*) FILTER (WHERE optimized = 'no') AS no, count(*) FILTER (WHERE optimized = 'uncertain') AS uncertain FROM labelled GROUP BY ALL")
def confusion_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(bound(spark, d, "labelled").select(F.coalesce("human", F.lit("missing")).alias("human"), "optimized"), "human", "optimized", ["yes", "no", "uncertain"])


@query(oracle("labelled") + """, p AS (SELECT repository, issue_number FROM labelled WHERE human IN ('yes', 'uncertain', 'insufficient_context')), c AS (SELECT DISTINCT repository, issue_number FROM labelled WHERE baseline = 'yes'),
j AS (SELECT c.issue_number IS NOT NULL AS hit FROM p LEFT JOIN c USING (repository, issue_number))
SELECT count(*) AS positives, count(*) FILTER (WHERE hit) AS hits, round(count(*) FILTER (WHERE hit) / count(*), 9) AS recall, count(*) FILTER (WHERE NOT hit) AS false_negatives FROM j""")
def candidate_recall(spark: SparkSession, d: str) -> DataFrame:
    rows = bound(spark, d, "labelled")
    return _rounded(metrics.candidate_recall(rows.where(F.col("human").isin("yes", "uncertain", "insufficient_context")), rows.where("baseline = 'yes'"), ["repository", "issue_number"]))


@query("SELECT l_orderkey, l_partkey, l.quality FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) p LEFT JOIN labels l ON l.doc_id = p.l_orderkey WHERE l.quality IS NULL OR l.toxic = 1")
def pairs_requiring_review(spark: SparkSession, d: str) -> DataFrame:
    pairs = sql(spark, d, "SELECT DISTINCT l_orderkey, l_partkey FROM {lineitem}")
    joined = pairs.join(spark.read.parquet(f"{d}/labels.parquet"), F.col("l_orderkey") == F.col("doc_id"), "left")
    return joined.where("quality IS NULL OR toxic = 1").select("l_orderkey", "l_partkey", "quality")


@query(oracle("labelled") + f""" SELECT doc_id, {CLASS.format(g='baseline')} AS baseline_class, {CLASS.format(g='optimized')} AS optimized_class,
  CASE WHEN human = 'yes' AND optimized <> 'yes' THEN CASE WHEN baseline <> 'yes' THEN 'stage1_miss' WHEN n_chars < 1500 THEN 'stage2_false_negative' ELSE 'aggregation_false_negative' END
    WHEN human = 'no' AND optimized = 'yes' THEN CASE WHEN n_chars >= 1500 THEN 'stage2_false_positive' ELSE 'aggregation_false_positive' END ELSE 'not_determinable' END AS origin
FROM labelled WHERE labelled AND baseline <> optimized""")
def ab_audit(spark: SparkSession, d: str) -> DataFrame:
    rows = bound(spark, d, "labelled").where("labelled and baseline <> optimized")
    c = {n: F.col(n) for n in ("human", "baseline", "optimized")}
    return rows.select(
        "doc_id", metrics.classification(c["human"], c["baseline"]).alias("baseline_class"), metrics.classification(c["human"], c["optimized"]).alias("optimized_class"),
        metrics.origin(c["human"], c["optimized"], c["baseline"] == "yes", F.col("n_chars") >= 1500).alias("origin"),
    )


@query(oracle("labelled") + """, m AS (SELECT count(*) FILTER (WHERE human = 'yes' AND baseline <> 'yes') AS base_missed, count(*) FILTER (WHERE human = 'yes' AND optimized <> 'yes' AND baseline = 'yes') AS newly_missed,
  CAST(NULL AS DOUBLE) AS saved FROM labelled), g AS (SELECT 'recall' AS gate, CASE WHEN base_missed <= 1000 THEN 'true' ELSE 'false' END AS state FROM m
  UNION ALL SELECT 'no_new_misses', CASE WHEN newly_missed = 0 THEN 'true' ELSE 'false' END FROM m UNION ALL SELECT 'tokens', CASE WHEN saved IS NULL THEN 'NOT_MEASURED' WHEN saved > 0 THEN 'true' ELSE 'false' END FROM m)
SELECT * FROM g UNION ALL SELECT 'overall', CASE WHEN bool_and(state = 'true') THEN 'true' ELSE 'false' END FROM g""")
def ab_gates(spark: SparkSession, d: str) -> DataFrame:
    rows = bound(spark, d, "labelled").where("human = 'yes'").select("doc_id", "baseline", "optimized")
    missed = lambda side: rows.where(F.col(side) != "yes").select("doc_id")
    new = missed("optimized").exceptAll(missed("baseline")).agg(F.count("*").alias("new"))
    one = missed("baseline").agg(F.count("*").alias("base")).join(F.broadcast(new))  # one row each
    saved = F.lit(None).cast("double")
    gates = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), g.alias("state")) for n, g in (
        ("recall", metrics.gate(F.col("base"), F.col("base") <= 1000)), ("no_new_misses", metrics.gate(F.col("new"), F.col("new") == 0)), ("tokens", metrics.gate(saved, saved > 0)))])).alias("x")).select("x.*")
    overall = gates.agg(F.when(F.bool_and(F.col("state") == "true"), "true").otherwise("false").alias("state")).select(F.lit("overall").alias("gate"), "state")
    return gates.unionByName(overall)


@query(oracle("labelled") + """ SELECT lang, repository, count(*) AS positives, count(*) FILTER (WHERE optimized = 'yes') AS found, round(count(*) FILTER (WHERE optimized = 'yes') / count(*), 9) AS recall, bool_and(optimized = 'yes') AS complete
FROM labelled WHERE human = 'yes' GROUP BY GROUPING SETS ((), (lang), (repository))""")
def recall_by_group(spark: SparkSession, d: str) -> DataFrame:
    rows = bound(spark, d, "labelled").where("human = 'yes'")
    hit = F.col("optimized") == "yes"
    out = rows.groupingSets([[], [F.col("lang")], [F.col("repository")]], "lang", "repository").agg(F.count("*").alias("positives"), F.count_if(hit).alias("found"), F.round(F.count_if(hit) / F.count("*"), 9).alias("recall"), F.bool_and(hit).alias("complete"))
    return out


CONFIGS = """r AS (SELECT lang AS fold, c.config, CASE WHEN human = 'yes' AND n_chars < c.least THEN 1 ELSE 0 END AS misses, CASE WHEN n_chars >= c.least THEN n_chars % 50 ELSE 0 END AS shortlist, n_chars // 4 AS tokens
  FROM labelled, (VALUES ('a', 500), ('b', 1000), ('c', 2000)) AS c(config, least) WHERE labelled)"""


@query(oracle("labelled") + ", " + CONFIGS + """, o AS (SELECT fold, config, sum(misses) AS m, sum(shortlist) AS s, count(*) AS n, sum(tokens) AS t FROM r GROUP BY ALL),
a AS (SELECT config, sum(m) AS tm, sum(s) AS ts, sum(n) AS tn, sum(t) AS tt FROM o GROUP BY config)
SELECT fold, config AS chosen, m::BIGINT AS held_out_misses FROM o JOIN a USING (config) QUALIFY row_number() OVER (PARTITION BY fold ORDER BY tm - m, round((ts - s) / nullif(tn - n, 0), 9), tt - t, config) = 1""")
def leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    rows = bound(spark, d, "labelled").where("labelled").select(F.col("lang").alias("fold"), "human", "n_chars", F.explode(F.array(*[F.struct(F.lit(n).alias("config"), F.lit(k).alias("least")) for n, k in (("a", 500), ("b", 1000), ("c", 2000))])).alias("c")).select("*", "c.*")
    kept = F.col("n_chars") >= F.col("least")
    rows = rows.withColumns({"misses": ((F.col("human") == "yes") & ~kept).cast("int"), "shortlist": F.when(kept, F.col("n_chars") % 50).otherwise(0), "tokens": F.floor(F.col("n_chars") / 4)})
    return metrics.leave_one_out(rows.withColumn("misses", F.coalesce("misses", F.lit(0))), "fold", "config", "misses", "shortlist", "tokens")


@query(oracle("labelled") + """, u AS (SELECT doc_id, 1 AS rank, human AS verdict, NULL AS guess FROM labelled WHERE human IS NOT NULL UNION ALL SELECT doc_id, 2, baseline, optimized FROM labelled)
SELECT doc_id, verdict, guess FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rank) = 1""")
def label_source_union(spark: SparkSession, d: str) -> DataFrame:
    rows = bound(spark, d, "labelled")
    pairs = rows.where("human is not null").select("doc_id", F.col("human").alias("verdict"))
    inferred = rows.select("doc_id", F.col("baseline").alias("verdict"), F.col("optimized").alias("guess"))
    return metrics.label_union([(1, pairs), (2, inferred)], ["doc_id"])


@query("""WITH c AS (SELECT unnest(['quality', 'toxic', 'lang', 'source']) AS "column", unnest([concat('', quality), concat('', toxic), lang, source]) AS v FROM labels l JOIN documents d USING (doc_id))
SELECT "column", coalesce(nullif(v, ''), '(missing)') AS value, count(*) AS "rows" FROM c GROUP BY ALL""")
def gold_distributions(spark: SparkSession, d: str) -> DataFrame:
    rows = sql(spark, d, "SELECT l.quality, l.toxic, d.lang, d.source FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id")
    return metrics.value_counts(rows, ["quality", "toxic", "lang", "source"])


@query("""SELECT 'duplicate' AS rule, concat('', conv_id, '/', role) AS key, count(*) AS n FROM conversations GROUP BY conv_id, role HAVING count(*) > 1
UNION ALL SELECT 'blank', concat('', doc_id), count(*) FROM documents WHERE coalesce(trim(text), '') = '' GROUP BY doc_id
UNION ALL SELECT 'collision', lower(trim(regexp_replace(p_type, '[^A-Za-z0-9]+', ' ', 'g'))), count(DISTINCT p_type) FROM (SELECT p_type FROM part UNION ALL SELECT replace(p_type, ' ', '_') FROM part) GROUP BY 2 HAVING count(DISTINCT p_type) > 1""")
def key_violations(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.vocab import collisions

    talks = audit.duplicate_keys(sql(spark, d, "SELECT conv_id, role FROM {conversations}"), ["conv_id", "role"]).select(F.lit("duplicate").alias("rule"), F.concat("conv_id", F.lit("/"), "role").alias("key"), F.col("count").alias("n"))
    blank = audit.blank_keys(sql(spark, d, "SELECT doc_id, text FROM {documents}"), ["text"]).groupBy("doc_id").count().select(F.lit("blank").alias("rule"), F.concat(F.lit(""), "doc_id").alias("key"), F.col("count").alias("n"))
    names = sql(spark, d, "SELECT p_type AS canonical FROM {part} UNION ALL SELECT replace(p_type, ' ', '_') FROM {part}")
    return talks.unionByName(blank).unionByName(collisions(names, ascii_only=True).select(F.lit("collision").alias("rule"), F.col("fp").alias("key"), F.col("names").alias("n")))
