"""Candidate categories for texts: phrases, TF-IDF, latent semantics and dense vectors, and how they combine."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import phrase_in, terms
from ..sizes import tasks
from ..workers import ready
from .catalog import require_bounded

MOST_ENTRIES = 5_000
_ROWS = 256  # texts that a Python worker scores at once


@dataclass(frozen=True)
class Config:
    """How many candidates to take, and when a retrieval is too weak to trust."""

    minimum: int = 5
    maximum: int = 10
    threshold: float = 0.18
    confidence: float = 0.55
    ambiguity: float = 0.8
    require_anchor: bool = True
    enabled: bool = True
    force_all: bool = False
    fall_back_to_all: bool = True
    fallback_multiplier: int = 2
    family_expansion: bool = True

    def __post_init__(self) -> None:
        if not (0 < self.minimum <= self.maximum) or not all(0 <= x <= 1 for x in (self.threshold, self.confidence, self.ambiguity)) or self.fallback_multiplier < 1:
            raise ValueError("a setting is out of its range")


def words(x: Column, unicode: bool = True) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(r"(?U)\w+" if unicode else r"[A-Za-z0-9_]+"), F.lit(0))


def lexical_matches(docs: DataFrame, key: str, text: str, rules: DataFrame, unicode: bool = True) -> DataFrame:
    """(key, pattern, phrase, direct) of every rule whose phrase stands in the text.

    A phrase can only be there if its first word is, so a document's distinct words meet the rules by
    that word (an equi-join with the bounded, broadcast rules) and the regular expression runs on what is left.
    """
    require_bounded(rules, MOST_ENTRIES * 20, "the table of phrases")
    keyed = F.broadcast(rules.withColumn("_first", F.get(words(F.col("phrase"), unicode), F.lit(0))).where("_first is not null"))
    low = docs.select(key, text, F.lower(text).alias("_low"), F.col(text).rlike("[\u0130\u017F\u212A]").alias("_odd"))
    seen = low.select("*", F.explode(F.array_distinct(words(F.col(text), unicode))).alias("_first"))
    # a plain search first: the regular expression only has to tell whole words (and letters with odd cases)
    near = F.contains("_low", F.lower(F.trim("phrase"))) | F.col("_odd") | F.col("phrase").rlike(r"[^\x00-\x7F]")
    hits = seen.join(keyed, "_first").where(near).where(phrase_in(F.col("phrase"), F.col(text))).select(key, "pattern", "phrase", "direct")
    odd = rules.where(F.get(words(F.col("phrase"), unicode), F.lit(0)).isNull() & (F.trim("phrase") != ""))
    if odd.isEmpty():
        return hits
    return hits.unionByName(docs.select(key, text).join(F.broadcast(odd), phrase_in(F.col("phrase"), F.col(text))).select(key, "pattern", "phrase", "direct"))


def literal_passages(docs: DataFrame, key: str, text: str, passages: DataFrame, passage_key: str, passage: str) -> DataFrame:
    """(key, passage_key) of passages that stand in a text as they are.

    The longest inner word of a passage (not its first or last, which may be cut) is a whole word of any
    text that holds it: texts and passages meet on it before the texts are searched. Passages without an
    inner word, few by nature, are searched for in every text.
    """
    split = F.split(F.col(passage), r"[^A-Za-z]+")
    inner = F.when(F.size(split) > 2, F.slice(split, F.lit(2), F.size(split) - 2)).otherwise(F.array().cast("array<string>"))
    longest = F.array_max(F.transform(F.filter(inner, lambda w: w != ""), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    require_bounded(passages, MOST_ENTRIES * 4, "the table of passages")
    rules = passages.where(F.col(passage) != "").select(passage_key, F.col(passage).alias("_passage"), longest["w"].alias("_word"))
    seen = docs.select(key, text, F.explode(F.array_distinct(F.split(F.col(text), r"[^A-Za-z]+"))).alias("_word"))
    found = seen.join(F.broadcast(rules.where("_word is not null")), "_word").where(F.contains(F.col(text), F.col("_passage"))).select(key, passage_key)
    short = rules.where("_word is null")
    if not short.isEmpty():
        found = found.unionByName(docs.select(key, text).join(F.broadcast(short), F.contains(F.col(text), F.col("_passage"))).select(key, passage_key))
    return found.distinct()


def term_counts(docs: DataFrame, key: str, text: str, ascii_only: bool = False) -> DataFrame:
    return docs.select(key, F.explode(terms(F.col(text), ascii_only)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def inverse_frequency(counts: DataFrame, documents: int) -> DataFrame:
    """(term, df, idf) with idf = ln((1 + n) / (1 + df)) + 1."""
    return counts.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log((1.0 + documents) / (1 + F.col("df"))) + 1)


def weighted(counts: DataFrame, idf: DataFrame, key: str, unit: bool = True) -> DataFrame:
    """(key, term, w): (1 + ln tf) * idf, at unit length for each key if asked."""
    rows = counts.join(idf.select("term", "idf"), "term").select(key, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    if not unit:
        return rows
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return rows.select(key, "term", (F.col("w") / F.greatest(norm, F.lit(1e-12))).alias("w"))


def tfidf_scores(docs: DataFrame, key: str, text: str, catalog: DataFrame, name: str, description: str, ascii_only: bool = False) -> DataFrame:
    """(key, name, score): cosine of each text with each catalog entry that shares a term, at the catalog's weights.

    The catalog is bounded and broadcast; texts are counted, weighted and matched by term, never crossed.
    """
    n = require_bounded(catalog, MOST_ENTRIES, "the catalog")
    catalog_counts = term_counts(catalog, name, description, ascii_only)
    idf = inverse_frequency(catalog_counts, n)
    entries = weighted(catalog_counts, idf, name)
    # only terms of the catalog go on, dealt by text once: counts, norms and scores all group within that, in tasks of a bounded size
    seen = docs.select(key, F.explode(terms(F.col(text), ascii_only)).alias("term")).join(F.broadcast(idf.select("term", "idf")), "term").repartition(tasks(docs), F.col(key))
    own = seen.groupBy(key, "term").agg(((1 + F.log(F.count("*"))) * F.first("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    own = own.select(key, "term", (F.col("w") / F.greatest(norm, F.lit(1e-12))).alias("w"))
    return own.join(F.broadcast(entries.withColumnRenamed("w", "v")), "term").groupBy(key, name).agg(F.sum(F.col("w") * F.col("v")).alias("score"))


@dataclass(frozen=True)
class Latent:
    """Term projection and unit vectors of the entries in a latent space."""

    terms: dict[str, int]
    idf: np.ndarray
    projection: np.ndarray
    entries: np.ndarray
    names: tuple[str, ...]


def fit_latent(catalog: DataFrame, name: str, description: str, dimensions: int = 32) -> Latent:
    """Latent semantics of a bounded catalog: the Gram matrix of its unit TF-IDF rows, on the driver."""
    require_bounded(catalog, 2_000, "the catalog")
    rows = catalog.select(name, terms(F.col(description)).alias("t")).orderBy(name).collect()
    counts, n = [Counter(r["t"]) for r in rows], len(rows)
    present = Counter(t for c in counts for t in c)
    vocabulary = {t: i for i, t in enumerate(sorted(present))}
    idf = np.log((1 + n) / (1 + np.array([present[t] for t in vocabulary], dtype=float))) + 1
    m = np.zeros((n, len(vocabulary)))
    for i, c in enumerate(counts):
        for t, f in c.items():
            m[i, vocabulary[t]] = (1 + math.log(f)) * idf[vocabulary[t]]
    unit_rows = lambda x: x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
    m = unit_rows(m)
    values, vectors = np.linalg.eigh(m @ m.T)  # ascending
    strong = values > 1e-10
    values, vectors = values[strong][-dimensions:], vectors[:, strong][:, -dimensions:]
    projection = m.T @ (vectors / np.sqrt(values))
    entries = unit_rows(m @ projection)
    return Latent(vocabulary, idf, projection, entries, tuple(r[name] for r in rows))


def latent_scores(docs: DataFrame, text: str, model: Latent, out: str = "scores") -> DataFrame:
    """Add the text's score with every entry, in the entries' order: within 0 and 1, to 8 places."""
    ready(docs.sparkSession)

    @F.arrow_udf("array<double>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.concat_arrays([_scores(column.slice(i, _ROWS), model) for i in range(0, max(1, len(column)), _ROWS)])

    return docs.withColumn(out, score(terms(F.col(text))))


def _scores(texts: pa.Array, model: Latent) -> pa.Array:
    """Scores of some rows of terms. The terms stay in Arrow's buffers; only those of the catalog are looked at, in the order of the text."""
    size = np.asarray(texts.value_lengths().fill_null(0))
    values = texts.flatten()
    place = np.asarray(pc.index_in(values, value_set=pa.array(sorted(model.terms, key=model.terms.get), values.type)).fill_null(-1))
    row = np.repeat(np.arange(len(texts)), size)
    pairs, first, count = np.unique((row * max(1, len(model.idf)) + place)[place >= 0], return_index=True, return_counts=True)
    pairs, count = pairs[np.argsort(first)], count[np.argsort(first)]
    row, place = np.divmod(pairs, max(1, len(model.idf)))
    logs = {int(c): 1 + math.log(int(c)) for c in np.unique(count)}
    weight = np.array([logs[int(c)] for c in count]) * model.idf[place]
    queries = np.zeros((len(texts), model.projection.shape[1]))
    np.add.at(queries, row, weight[:, None] * model.projection[place])
    told = np.array([np.clip(model.entries @ (q / max(float(np.linalg.norm(q)), 1e-12)), 0, 1) for q in queries]).reshape(-1)
    flat = np.array([round(v, 8) for v in told.tolist()], dtype=float)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * len(model.names), pa.int32()), pa.array(flat))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    norm = F.greatest(F.sqrt(dot(a, a)), F.lit(1e-12))
    return F.transform(a, lambda x: x.cast("double") / norm)


def dense_cosines(chunks: DataFrame, key: str, vector: str, entries: DataFrame, name: str, entry: str, chunk: str = "chunk") -> DataFrame:
    """(key, name, score, chunk): the best chunk of each key for each entry, by the cosine of their vectors.

    Vectors are brought to unit length, cosines are kept within -1 and 1 and rounded to 8 places; the first
    of equal chunks counts. The entries are a bounded catalog; a key has a row an entry.
    """
    require_bounded(entries, MOST_ENTRIES, "the table of vectors")
    packed = entries.agg(F.collect_list(F.struct(F.col(name).alias("n"), unit(F.col(entry)).alias("e"))).alias("_all"))
    rows = chunks.select(key, chunk, unit(F.col(vector)).alias("_v")).join(F.broadcast(packed))  # one row
    cosine = lambda e: F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("_v"), e["e"]))), 8)
    scored = rows.select(key, chunk, F.explode(F.transform("_all", lambda e: F.struct(e["n"].alias("n"), cosine(e).alias("s")))).alias("x"))
    return max_over_chunks(scored.select(key, chunk, F.col("x.n").alias(name), F.col("x.s").alias("_s")), [key, name], chunk, "_s")


def dense_topk(queries: DataFrame, key: str, vector: str, entries: DataFrame, name: str, entry: str, k: int) -> DataFrame:
    """(key, name, score, rank) of the k entries with the largest inner product; the entries are a bounded catalog."""
    require_bounded(entries, MOST_ENTRIES, "the table of vectors")
    best = F.collect_list(F.struct(F.col(name).alias("n"), F.col(entry).alias("e")))
    packed = entries.agg(best.alias("_all"))
    scored = queries.select(key, vector).join(F.broadcast(packed))  # one row
    pairs = F.transform("_all", lambda e: F.struct((-F.round(dot(F.col(vector), e["e"]), 6)).alias("s"), e["n"].alias("n")))
    top = scored.select(key, F.posexplode(F.slice(F.array_sort(pairs), 1, k)).alias("i", "x"))
    return top.select(key, F.col("x.n").alias(name), (-F.col("x.s")).alias("score"), (F.col("i") + 1).alias("rank"))


def max_over_chunks(chunks: DataFrame, key: Sequence[str], index: str, score: str) -> DataFrame:
    """(key, score, chunk): the best chunk of each key, the first of equals."""
    return chunks.groupBy(*key).agg(F.max(score).alias("score"), F.max_by(F.col(index), F.struct(F.col(score), -F.col(index))).alias("chunk"))


def shortlist(docs: DataFrame, scores: str, lexical: str, names: Sequence[str], families: Sequence[Sequence[str]], config: Config = Config(), second: str | None = None) -> DataFrame:  # noqa: B008
    """Add the combined shortlist of each row.

    ``names`` are the entries in id order; ``scores`` (and ``second``, another backend's) hold one score for
    each of them and ``lexical`` the places of those that phrases found. All of it happens in the row, on
    arrays as long as the catalog: nothing is shuffled. Added: candidates (names in id order), reasons (a
    list for each), fallback_used, fallback_reasons, full_fallback, fallback_added, family_added.
    """
    n, of = len(names), {m: f for f, g in enumerate(families) for m in g}
    every = F.sequence(F.lit(0), F.lit(n - 1))
    family = F.array(*[F.lit(of.get(m, -1)) for m in names])
    none = F.array().cast("array<int>")
    has = lambda a, i: F.array_contains(F.col(a) if isinstance(a, str) else a, i)
    ranked = lambda s: F.transform(F.array_sort(F.transform(s, lambda v, i: F.struct((-v).alias("v"), i.alias("i")))), lambda x: x["i"])
    df = docs.withColumns({"_r": ranked(scores), "_lex": F.coalesce(F.col(lexical).cast("array<int>"), none)} | ({"_r2": ranked(second)} if second else {}))

    def over(order: str, s: str) -> Column:
        return F.filter(F.slice(order, 1, config.maximum), lambda i: F.get(F.col(s), i) >= config.threshold)

    sets = {"lexical": F.col("_lex"), "semantic_minimum": F.slice("_r", 1, config.minimum), "semantic_threshold": over("_r", scores)}
    if second:
        sets |= {"lsa_minimum": F.slice("_r2", 1, config.minimum), "lsa_threshold": over("_r2", second)}
    df = df.withColumns({f"_s_{k}": v for k, v in sets.items()})
    top = F.coalesce(F.get(F.col(scores), F.get(F.col("_r"), F.lit(0))), F.lit(0.0))
    df = df.withColumn("_top", top)
    bar = F.greatest(F.lit(config.threshold / 2), F.col("_top") * config.ambiguity)
    ambiguous = F.size(F.filter(scores, lambda v: v >= bar)) > config.maximum
    flags = {"low_confidence": F.col("_top") < config.confidence, "ambiguous_similarity": ambiguous, "no_lexical_anchor": F.lit(config.require_anchor) & (F.size("_lex") == 0)}
    if not config.enabled or config.force_all:
        why = F.array(F.lit("forced_full_catalog" if config.enabled else "disabled"))
    else:
        why = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()]), lambda x: x.isNotNull())
    df = df.withColumn("fallback_reasons", why)
    weak = F.size("fallback_reasons") > 0
    all_of_them = weak if config.fall_back_to_all or not config.enabled or config.force_all else F.lit(False)
    more = F.when(weak & ~all_of_them, F.slice("_r", 1, config.fallback_multiplier * config.maximum)).otherwise(none)
    chosen = F.col("_lex")
    for k in sets:
        chosen = F.array_union(chosen, F.col(f"_s_{k}"))
    df = df.withColumn("_s_expanded_fallback", more)
    df = df.withColumn("_pre", F.when(all_of_them, every).otherwise(F.array_union(chosen, F.col("_s_expanded_fallback"))))
    touched = F.array_distinct(F.filter(F.transform("_pre", lambda i: F.get(family, i)), lambda f: f >= 0))
    df = df.withColumn("_touched", touched)
    added = F.filter(every, lambda i: has("_touched", F.get(family, i)) & ~has("_pre", i)) if config.family_expansion else none
    df = df.withColumn("_s_family_expansion", added)
    df = df.withColumn("_all", F.array_sort(F.array_union("_pre", "_s_family_expansion")))
    told = [*sets, "expanded_fallback", "family_expansion"]
    full = weak & F.lit(config.fall_back_to_all) & (F.size("_pre") == n)
    table = F.array(*map(F.lit, names))
    own = [F.col(c) for c in docs.columns]
    return df.select(
        *own, F.transform("_all", lambda i: F.get(table, i)).alias("candidates"),
        F.transform("_all", lambda i: F.filter(F.array(*[F.when(has(f"_s_{k}", i), F.lit(k)) for k in told]), lambda x: x.isNotNull())).alias("reasons"),
        weak.alias("fallback_used"), "fallback_reasons", full.alias("full_fallback"), F.when(full, F.size(F.array_except("_pre", "_lex"))).otherwise(0).alias("fallback_added"), F.size("_s_family_expansion").alias("family_added"),
    )


def false_friends(docs: DataFrame, key: str, text: str, candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, pattern, reason): rules (pattern, regex, reason) that hit a text, for its own candidates only.

    Candidates are gathered into one small array a key first, so a text is met once, not once a rule.
    """
    require_bounded(rules, MOST_ENTRIES, "the table of rules")
    held = candidates.join(F.broadcast(rules.select("pattern").distinct()), "pattern", "left_semi").groupBy(key).agg(F.collect_set("pattern").alias("_due"))
    due = docs.select(key, text).join(held, key).select(key, text, F.explode("_due").alias("pattern")).join(F.broadcast(rules), "pattern")
    return due.where(F.regexp_like(F.col(text), F.col("regex"))).select(key, "pattern", "reason")


def expand_families(selected: DataFrame, key: str, name: str, members: DataFrame) -> DataFrame:
    """(key, name): the selected entries and all others of their families; ``members`` is (family, name)."""
    require_bounded(members, MOST_ENTRIES, "the table of families")
    touched = selected.join(F.broadcast(members), name).select(key, "family").distinct()
    grown = touched.join(F.broadcast(members), "family").select(key, name)
    return selected.select(key, name).unionByName(grown).distinct()


def miss_kind(score: Column, second: Column, found: Column, threshold: float, related: Column) -> Column:
    """Why a labelled entry was missed."""
    return F.when(found, F.lit(None)).when(F.greatest(score, second) <= 0, "paraphrase_not_captured").when(score >= threshold, "other").when(related, "missing_family_relation").when(score >= threshold / 2, "threshold_too_high").otherwise("semantic_model_failure")
