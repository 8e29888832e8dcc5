"""Evaluation against labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .audit import Violation
from .catalog import require_bounded


def ratio(a: Column, b: Column) -> Column:
    """Null, never 0, where the ratio has no meaning."""
    return F.try_divide(a.cast("double"), b)


def binary_metrics(df: DataFrame, truth: str, guess: str, by: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Counts and rates of yes/no guesses. Rows with any other label are left out, or an error if ``strict``."""
    pair = F.col(truth).isin("yes", "no") & F.col(guess).isin("yes", "no")
    if strict and not df.where(~F.coalesce(pair, F.lit(False))).isEmpty():
        raise Violation("labels other than yes and no")
    hit = lambda t, g: F.count_if((F.col(truth) == t) & (F.col(guess) == g))
    counts = df.where(pair).groupBy(*by).agg(F.count("*").alias("n"), hit("yes", "yes").alias("tp"), hit("no", "no").alias("tn"), hit("no", "yes").alias("fp"), hit("yes", "no").alias("fn"))
    return with_rates(counts)


def with_rates(counts: DataFrame) -> DataFrame:
    """Add the rates to n, tp, tn, fp, fn."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    first = {"accuracy": ratio(tp + tn, F.col("n")), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "false_positive_rate": ratio(fp, fp + tn), "false_negative_rate": ratio(fn, fn + tp), "negative_predictive_value": ratio(tn, tn + fn)}
    p, r = F.col("precision"), F.col("recall")
    return counts.withColumns(first).withColumns({"f1": F.try_divide(2 * p * r, p + r), "balanced_accuracy": (r + F.col("specificity")) / 2})


def classification(truth: Column, guess: Column) -> Column:
    """TP, FP, FN, TN, or the reason why a row is left out."""
    return (
        F.when(~truth.isin("yes", "no") | truth.isNull(), F.concat(F.lit("EXCLUDED_HUMAN_"), F.upper(F.coalesce(truth, F.lit("missing")))))
        .when(~guess.isin("yes", "no") | guess.isNull(), F.concat(F.lit("EXCLUDED_PREDICTION_"), F.upper(F.coalesce(guess, F.lit("missing")))))
        .when(truth == "yes", F.when(guess == "yes", "TP").otherwise("FN")).otherwise(F.when(guess == "yes", "FP").otherwise("TN"))
    )


def confusion(df: DataFrame, truth: str, guess: str, values: Sequence[str]) -> DataFrame:
    """Truth by guess, zeros included; the guesses are named, so no pass is needed to find them."""
    wide = df.groupBy(F.coalesce(truth, F.lit("missing")).alias(truth)).pivot(guess, list(values)).count()
    return wide.na.fill(0, list(values))


def distribution(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact n, sum, mean, median, p95 (linear between neighbours), min and max; all but n null if nothing is measured."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.percentile(v, 0.95).alias("p95"), F.min(v).alias("minimum"), F.max(v).alias("maximum"))


def candidate_recall(positives: DataFrame, candidates: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: positive pairs, those among the candidates, recall and misses."""
    hits = positives.select(*key).distinct().join(candidates.select(*key).distinct().withColumn("_hit", F.lit(True)), list(key), "left")
    out = hits.agg(F.count("*").alias("positives"), F.count_if(F.col("_hit")).alias("hits"))
    return out.withColumns({"recall": ratio(F.col("hits"), F.col("positives")), "false_negatives": F.col("positives") - F.col("hits")})


def label_union(sources: Sequence[tuple[int, DataFrame]], key: Sequence[str]) -> DataFrame:
    """Labels of several sources by precedence (lower first): one row a key, with all columns of all sources."""
    rows = None
    for rank, df in sources:
        tagged = df.withColumn("_rank", F.lit(rank))
        rows = tagged if rows is None else rows.unionByName(tagged, allowMissingColumns=True)
    best = F.row_number().over(Window.partitionBy(*key).orderBy("_rank", *[F.col(c) for c in sorted(rows.columns) if c not in (*key, "_rank")]))
    return rows.withColumn("_n", best).where("_n = 1").drop("_n", "_rank")


def pair_quality(labels: DataFrame, candidates: DataFrame, results: DataFrame, key: Sequence[str], truth: str = "human_verdict", guess: str = "verdict") -> DataFrame:
    """One row a view of how pairs were told: ``conditional`` counts labelled pairs with a yes or no result,
    ``end_to_end`` all labelled pairs, of which those without a yes result count as no; and the recall of the candidates.

    ``results`` are succeeded ones, one a key; labels other than yes and no are left out.
    """
    known = labels.where(F.col(truth).isin("yes", "no")).select(*key, F.col(truth).alias("t"))
    rows = known.join(results.select(*key, F.col(guess).alias("g")), list(key), "left").join(candidates.select(*key).distinct().withColumn("c", F.lit(True)), list(key), "left")
    views = F.array(F.struct(F.lit("conditional").alias("view"), F.col("g").alias("guess")), F.struct(F.lit("end_to_end").alias("view"), F.when(F.col("g") == "yes", "yes").otherwise("no").alias("guess")))
    recall = rows.agg(ratio(F.count_if((F.col("t") == "yes") & F.col("c")), F.count_if(F.col("t") == "yes")).alias("candidate_recall"))
    counts = binary_metrics(rows.select("t", F.explode(views).alias("v")).select("t", "v.*"), "t", "guess", ["view"])
    return counts.join(F.broadcast(recall))  # one row


def with_diagnosis(rows: DataFrame, key: str, label: str, notes: DataFrame, default: str = "needs_human_review") -> DataFrame:
    """Add ``diagnosis``: for false positives and negatives what ``notes`` (key, diagnosis; bounded) says of them, or ``default``; else blank."""
    require_bounded(notes, 100_000, "the table of notes")
    wrong = F.col(label).isin("FP", "FN")
    joined = rows.join(F.broadcast(notes.select(key, F.col("diagnosis").alias("_note"))), key, "left")
    return joined.withColumn("diagnosis", F.when(wrong, F.coalesce("_note", F.lit(default))).otherwise("")).drop("_note")


def recovery(due: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How gold pairs were recovered: pairs, hits, those found by semantics alone or by family alone, and recall.

    ``due``: one row a gold pair with ``reasons``, the array of mechanisms that found it (null or empty: none).
    """
    r = F.coalesce("reasons", F.array().cast("array<string>"))
    has = lambda *names: F.arrays_overlap(r, F.array(*map(F.lit, names)))
    hit, semantic = F.size(r) > 0, has("semantic_minimum", "semantic_threshold", "lsa_minimum", "lsa_threshold")
    out = due.groupBy(*by).agg(
        F.count("*").alias("pairs"), F.count_if(hit).alias("hits"), F.count_if(semantic & ~has("lexical")).alias("semantic_only"),
        F.count_if(hit & (F.size(F.array_except(r, F.array(F.lit("family_expansion")))) == 0)).alias("family_only"), F.count_if(has("lexical")).alias("lexical"),
    )
    return out.withColumns({"recall": ratio(F.col("hits"), F.col("pairs")), "lexical_rate": ratio(F.col("lexical"), F.col("pairs"))})


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, rows) of several columns in one pass; null and blank count as missing."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("(missing)")).alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("x")).groupBy("x.column", "x.value").agg(F.count("*").alias("rows"))


def false_positive_patterns(rows: DataFrame, pattern: str, label: str, evidence: str, pos: str) -> DataFrame:
    """Per pattern with a false positive: both counts, their share, and the evidence in order without repeats."""
    ordered = F.transform(F.array_sort(F.collect_list(F.when((F.col(label) == "FP") & (F.col(evidence) != ""), F.struct(F.col(pos).alias("p"), F.col(evidence).alias("v"))))), lambda x: x["v"])
    out = rows.groupBy(pattern).agg(F.count_if(F.col(label) == "FP").alias("fp"), F.count_if(F.col(label) == "TP").alias("tp"), F.array_distinct(ordered).alias("evidence"))
    return out.where("fp > 0").withColumn("fp_share", ratio(F.col("fp"), F.col("fp") + F.col("tp"))).orderBy(F.desc("fp"), pattern)


def gate(value: Column, good: Column) -> Column:
    """true, false, or NOT_MEASURED where there is no value."""
    return F.when(value.isNull(), "NOT_MEASURED").when(good, "true").otherwise("false")


def origin(truth: Column, guess: Column, has_candidate: Column, has_yes: Column) -> Column:
    """Where a wrong issue result comes from."""
    return (
        F.when((truth == "yes") & (guess != "yes"), F.when(~has_candidate, "stage1_miss").when(~has_yes, "stage2_false_negative").otherwise("aggregation_false_negative"))
        .when((truth == "no") & (guess == "yes"), F.when(has_yes, "stage2_false_positive").otherwise("aggregation_false_positive"))
        .otherwise("not_determinable")
    )


def leave_one_out(results: DataFrame, fold: str, config: str, misses: str, shortlist: str, tokens: str) -> DataFrame:
    """Per fold: the configuration that is best on all other folds by (misses, mean shortlist, tokens), and its misses here.

    The other folds' figures are the totals less the fold's own, so no fold meets another's rows.
    """
    own = results.groupBy(fold, config).agg(F.sum(misses).alias("m"), F.sum(shortlist).alias("s"), F.count("*").alias("n"), F.sum(tokens).alias("t"))
    total = own.groupBy(config).agg(F.sum("m").alias("tm"), F.sum("s").alias("ts"), F.sum("n").alias("tn"), F.sum("t").alias("tt"))
    rest = own.join(total, config).withColumns({"rm": F.col("tm") - F.col("m"), "rs": F.round(ratio(F.col("ts") - F.col("s"), F.col("tn") - F.col("n")), 9), "rt": F.col("tt") - F.col("t")})
    best = rest.groupBy(fold).agg(F.min_by(F.struct(F.col(config).alias("chosen"), F.col("m").alias("held_out_misses")), F.struct("rm", "rs", "rt", config)).alias("b"))
    return best.select(fold, "b.chosen", "b.held_out_misses")


def recommend(configs: DataFrame, eligible: Column, guarded: Column, shortlist: str, tokens: str, name: str) -> DataFrame:
    """Of the eligible configurations a guarded one if there is any, with the smallest mean shortlist, then fewest tokens."""
    return configs.where(eligible).orderBy(guarded.cast("int").desc(), shortlist, tokens, name).limit(1)
