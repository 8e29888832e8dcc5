"""Queries of retrieval and context: documents against the benchmark passages as a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS
from ..operators import retrieval, spans
from .bindings import sql
from .registry import registry

QUERIES, SQL, query = registry()

STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
FOLDED = "lower(strip_accents(replace(regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g'), 'ß', 'ss')))"


def _terms(table: str, key: str) -> str:
    """DuckDB text: (key, term, tf) of a table's terms: folded letters without accents."""
    return f"""(SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(regexp_extract_all({FOLDED}, '[a-z0-9]+')) AS term FROM {table}) WHERE length(term) > 1 AND term NOT IN ({STOP}) GROUP BY ALL)"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return sql(spark, d, "SELECT doc_id, text FROM {documents}")


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    return sql(spark, d, "SELECT item_id, text FROM {benchmark}")


@query("SELECT * FROM " + _terms("documents", "doc_id"))
def terms_tf(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.term_counts(_docs(spark, d), "doc_id", "text")


IDF = "c AS (SELECT * FROM " + _terms("benchmark", "item_id") + "), i AS (SELECT term, count(*) AS df, ln((1.0 + (SELECT count(*) FROM benchmark)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY term)"


@query("WITH " + IDF + " SELECT term, df, round(idf, 9) AS idf FROM i")
def idf(spark: SparkSession, d: str) -> DataFrame:
    entries = _catalog(spark, d)
    n = retrieval.require_bounded(entries, retrieval.MOST_ENTRIES, "the catalog")
    return retrieval.inverse_frequency(retrieval.term_counts(entries, "item_id", "text"), n).withColumn("idf", F.round("idf", 9))


SCORES = (
    "WITH " + IDF + ", t AS (SELECT * FROM " + _terms("documents", "doc_id") + """), cw AS (SELECT item_id, term, (1 + ln(tf)) * idf AS w FROM c JOIN i USING (term)), cn AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM cw GROUP BY item_id),
dw AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM t JOIN i USING (term)), dn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM dw GROUP BY doc_id),
s AS (SELECT doc_id, item_id, round(sum(dw.w * cw.w) / (any_value(dn.n) * any_value(cn.n)), 6) AS score FROM dw JOIN cw USING (term) JOIN dn USING (doc_id) JOIN cn USING (item_id) GROUP BY ALL)"""
)


def _scores(spark: SparkSession, d: str) -> DataFrame:
    out = retrieval.tfidf_scores(_docs(spark, d), "doc_id", "text", _catalog(spark, d), "item_id", "text")
    return out.withColumn("score", F.round("score", 6))


@query(SCORES + ", r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS k FROM s) SELECT doc_id, item_id, score, k::INTEGER AS rank FROM r WHERE k <= 5 OR (k <= 10 AND score >= 0.18)")
def tfidf_rank(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "item_id"))
    return _scores(spark, d).withColumn("rank", rank).where("rank <= 5 or (rank <= 10 and score >= 0.18)")


@query()
def lsa_retrieval(spark: SparkSession, d: str) -> DataFrame:
    model = retrieval.fit_latent(_catalog(spark, d), "item_id", "text")
    scored = retrieval.latent_scores(_docs(spark, d), "text", model)
    best = F.slice(F.array_sort(F.transform("scores", lambda s, i: F.struct((-s).alias("s"), i.alias("i")))), 1, 5)
    names = F.array(*map(F.lit, model.names))
    return scored.select("doc_id", F.posexplode(best).alias("k", "x")).select("doc_id", (F.col("k") + 1).alias("rank"), F.get(names, F.col("x.i")).alias("item_id"), (-F.col("x.s")).alias("score"))


@query("""WITH e AS (SELECT label, vec_id, embedding AS v FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
s AS (SELECT q.vec_id, e.label AS name, round(list_sum(list_transform(list_zip(q.embedding, e.v), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6) AS score FROM embeddings q, e)
SELECT vec_id, name, score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, name)::INTEGER AS rank FROM s QUALIFY rank <= 3""")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = sql(spark, d, "SELECT vec_id, embedding, label FROM {embeddings}")
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("e")).withColumnRenamed("label", "name")
    return retrieval.dense_topk(rows, "vec_id", "embedding", first, "name", "e", 3)


@query("""WITH c AS (SELECT label, vec_id // 10 AS grp, vec_id % 10 AS chunk, round(list_sum(embedding::DOUBLE[]), 3) AS score FROM embeddings)
SELECT grp, label, score, chunk FROM c QUALIFY row_number() OVER (PARTITION BY grp, label ORDER BY score DESC, chunk) = 1""")
def max_over_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = sql(spark, d, "SELECT label, vec_id DIV 10 AS grp, vec_id % 10 AS chunk, embedding FROM {embeddings}")
    summed = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return retrieval.max_over_chunks(rows.withColumn("s", F.round(summed, 3)), ["grp", "label"], "chunk", "s")


@query(
    SCORES + """, n AS (SELECT count(*) AS n FROM benchmark), x AS (SELECT d.doc_id, b.item_id, coalesce(s.score, 0) AS score, contains(lower(d.text), lower(split_part(b.text, ' ', 1) || ' ' || split_part(b.text, ' ', 2))) AS lex
  FROM documents d CROSS JOIN benchmark b LEFT JOIN s USING (doc_id, item_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS k, max(score) OVER (PARTITION BY doc_id) AS top, count(*) FILTER (WHERE lex) OVER (PARTITION BY doc_id) AS anchors FROM x),
f AS (SELECT doc_id, max(top) < 0.3 AS weak, count(*) FILTER (WHERE score >= greatest(0.09, top * 0.8)) > 10 AS many, max(anchors) = 0 AS loose FROM r GROUP BY doc_id),
p AS (SELECT r.*, weak OR many OR loose AS fell, lex OR k <= 5 OR (k <= 10 AND score >= 0.18) OR ((weak OR many OR loose) AND k <= 20) AS pre FROM r JOIN f USING (doc_id)),
g AS (SELECT doc_id, item_id % 8 AS fam FROM p WHERE pre GROUP BY ALL)
SELECT doc_id, string_agg(item_id, '|' ORDER BY item_id) AS candidates, any_value(fell) AS fallback_used, count(*) FILTER (WHERE NOT pre)::INTEGER AS family_added FROM (SELECT p.* FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND g.fam = p.item_id % 8 AND p.item_id % 4 = 0 WHERE pre OR g.fam IS NOT NULL) GROUP BY doc_id"""
)
def hybrid_shortlist(spark: SparkSession, d: str) -> DataFrame:
    entries = sql(spark, d, "SELECT item_id, lower(concat(split_part(text, ' ', 1), ' ', split_part(text, ' ', 2))) AS phrase FROM {benchmark}")
    retrieval.require_bounded(entries, 1_000, "the catalog")
    rows = entries.orderBy("item_id").collect()
    names = [r["item_id"] for r in rows]
    families = [[n for n in names if n % 8 == f and n % 4 == 0] for f in range(8)]
    found = _scores(spark, d).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("item_id", "score"))).alias("m"))
    docs = sql(spark, d, "SELECT doc_id, lower(text) AS text FROM {documents}")
    lexical = F.filter(F.array(*[F.when(F.contains("text", F.lit(r["phrase"])), F.lit(i)) for i, r in enumerate(rows)]), lambda x: x.isNotNull())
    scored = docs.select("doc_id", lexical.alias("lexical")).join(found, "doc_id", "left")
    table = F.array(*map(F.lit, names))
    scored = scored.select("doc_id", "lexical", F.transform(table, lambda n: F.coalesce(F.try_element_at(F.col("m"), n), F.lit(0.0))).alias("scores"))
    config = retrieval.Config(confidence=0.3, fall_back_to_all=False)
    out = retrieval.shortlist(scored, "scores", "lexical", names, families, config)
    return out.select("doc_id", F.array_join(F.transform("candidates", lambda x: x.cast("string")), "|").alias("candidates"), "fallback_used", "family_added")


@query("WITH s AS (SELECT doc_id, doc_id % 64 AS item_id FROM documents), m AS (SELECT item_id, item_id % 8 AS family FROM benchmark) SELECT * FROM s UNION SELECT s.doc_id, o.item_id FROM s JOIN m USING (item_id) JOIN m o USING (family)")
def family_expansion(spark: SparkSession, d: str) -> DataFrame:
    selected = sql(spark, d, "SELECT doc_id, doc_id % 64 AS item_id FROM {documents}")
    members = sql(spark, d, "SELECT item_id % 8 AS family, item_id FROM {benchmark}")
    return retrieval.expand_families(selected, "doc_id", "item_id", members)


@query()
def span_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = sql(spark, d, "SELECT doc_id, text FROM {documents}")
    cut = docs.select("doc_id", F.posexplode(spans.span_chunks(F.col("text"), 600)).alias("chunk", "s"))
    return cut.select("doc_id", "chunk", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


@query()
def context_select(spark: SparkSession, d: str) -> DataFrame:
    docs = sql(spark, d, "SELECT doc_id, text, '' AS comments, split_part(text, chr(10), 1) AS q FROM {documents}")
    out = spans.select_context(docs, "text", "comments", "q", 2000)
    return out.select("doc_id", F.sha2("context.body", 256).alias("body_sha256"), F.size("context.body_spans").alias("spans"), F.col("context.omitted").alias("omitted"))

