"""Whole evaluations and runs, composed of the operators. Results are DataFrames; nothing is collected but checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import remap_locations, stage2_confidence, succeeded
from ..functions.text import estimated_tokens, label_number, literal_match, stable_id
from ..operators import audit, metrics, requests, responses, retrieval, rollup, stages
from ..operators.prepare import prepare
from ..scratch import materialize
from ..types import KEY, PAIR_KEY, SUCCEEDED, VERDICTS


def evaluate_pairs(human_pairs: DataFrame, stage1: DataFrame, stage2: DataFrame, inferred: DataFrame | None = None) -> dict[str, DataFrame]:
    """Pair-level evaluation: recall of the shortlist, verdicts against labels, what still needs a label.

    ``human_pairs``: repository, issue_number, pattern, human_verdict; labels ``inferred`` from issues count
    only where there is no pair label.
    """
    labels = metrics.label_union([(1, human_pairs)] + ([(2, inferred)] if inferred is not None else []), PAIR_KEY)
    positives = labels.where(F.col("human_verdict").isin("yes", "uncertain", "insufficient_context"))
    candidates = stages.explode_pairs(stage1, strict=False)
    done = stage2.where(succeeded(F.col("request_status"))) if "request_status" in stage2.columns else stage2
    audit.require(audit.duplicate_keys(done, PAIR_KEY), "repeated pairs")
    joined = done.join(labels.select(*PAIR_KEY, "human_verdict"), list(PAIR_KEY), "left")
    unlabeled = F.coalesce("human_verdict", F.lit("")) == ""
    per_issue = stage1.select(*KEY).join(candidates.groupBy(*KEY).agg(F.count("*").alias("n")), list(KEY), "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    totals = joined.agg(F.count("*").alias("generated"), F.count_if(~unlabeled).alias("labeled"), F.count_if(unlabeled).alias("unlabeled"), F.count_if(F.col("verdict") == "uncertain").alias("uncertain"), F.count_if(F.col("verdict") == "insufficient_context").alias("insufficient"))
    rate = lambda c: metrics.ratio(F.col(c), F.col("generated"))
    return {
        "stage1": metrics.candidate_recall(positives, candidates, PAIR_KEY),
        "false_negatives": audit.unmatched(positives, candidates, PAIR_KEY),
        "candidates": per_issue.agg(F.avg("n").alias("mean"), F.median("n").alias("median"), F.count_if(F.col("n") == 0).alias("without_candidates")),
        "comparison": joined.where(~unlabeled),
        "review": joined.where(unlabeled),
        "binary": metrics.binary_metrics(joined.where(~unlabeled), "human_verdict", "verdict"),
        "confusion": metrics.confusion(joined.where(~unlabeled), "human_verdict", "verdict", VERDICTS),
        "stage2": totals.withColumns({"coverage": rate("labeled"), "uncertain_rate": rate("uncertain"), "insufficient_rate": rate("insufficient")}),
    }


def evaluate_issues(human: DataFrame, results: DataFrame, truth: str = "human_relevance", guess: str = "relevant_to_pattern_study") -> dict[str, DataFrame]:
    """Issue-level evaluation; every labelled issue must have one result."""
    human = human.withColumn("issue_number", label_number(F.col("issue_number")))
    results = results.select(*KEY, guess).withColumn("issue_number", label_number(F.col("issue_number")))
    audit.one_to_one(human, results, KEY)
    rows = human.join(results, list(KEY)).withColumn("classification", metrics.classification(F.col(truth), F.col(guess)))
    return {"rows": rows, "binary": metrics.binary_metrics(rows, truth, guess), "labels": rows.groupBy("classification").count()}


@dataclass(frozen=True)
class Run:
    """A finished run: its stage results, issue results and settings (name, value)."""

    stage1: DataFrame
    stage2: DataFrame
    issues: DataFrame
    settings: DataFrame
    total_tokens: float | None = None


def compare_runs(human: DataFrame, positives: DataFrame, baseline: Run, optimized: Run, same: Sequence[str] = ()) -> dict[str, DataFrame]:
    """A/B comparison: both runs against the labels, where they part, and gates with three values.

    Settings in ``same`` must agree and both runs must cover the labelled issues. Quality figures of a run
    whose pairs aren't whole are null.
    """
    picked = lambda r: r.settings.where(F.col("name").isin(*same)) if same else r.settings.limit(0)
    audit.require(audit.differing_settings(picked(baseline), picked(optimized)), "runs aren't comparable")
    sides, out = {"baseline": baseline, "optimized": optimized}, {}
    for name, run in sides.items():
        audit.require(audit.unmatched(human, run.issues, KEY), f"issues without a result in {name}")
        pairs = stages.explode_pairs(run.stage1, strict=False)
        out[f"{name}_integrity"] = stages.integrity(pairs, run.stage2)
        out[f"{name}_issues"] = evaluate_issues(human, run.issues)["binary"]
        out[f"{name}_recall"] = metrics.candidate_recall(positives, pairs, PAIR_KEY)
        out[f"{name}_funnel"] = stages.funnel(run.stage1, run.stage2, run.issues)
        done = run.stage2.where(succeeded(F.col("request_status"))).groupBy(*PAIR_KEY).agg(F.max("verdict").alias("verdict"))
        out[f"{name}_pairs"] = metrics.pair_quality(positives.withColumn("human_verdict", F.coalesce("human_verdict", F.lit("yes")) if "human_verdict" in positives.columns else F.lit("yes")), pairs, done, PAIR_KEY)
        sound = out[f"{name}_integrity"].select((F.col("status") == "OK").alias("_ok"))
        null_if = lambda df: df.join(F.broadcast(sound)).select(*[F.when(F.col("_ok"), F.col(c)).alias(c) for c in df.columns])  # noqa: E731, B023
        out[f"{name}_issues"], out[f"{name}_recall"] = null_if(out[f"{name}_issues"]), null_if(out[f"{name}_recall"])
    a = human.select(*KEY, "human_relevance")
    for name, run in sides.items():
        found = run.stage2.groupBy(*KEY).agg(F.bool_or((F.col("verdict") == "yes") & (F.col("request_status") == SUCCEEDED)).alias(f"{name}_has_yes"), F.count("*").alias(f"{name}_pairs"))
        a = a.join(run.issues.select(*KEY, F.col("relevant_to_pattern_study").alias(name)), list(KEY), "left").join(found, list(KEY), "left")
    truth = F.col("human_relevance")
    for name in sides:
        pairs, yes = F.coalesce(f"{name}_pairs", F.lit(0)) > 0, F.coalesce(f"{name}_has_yes", F.lit(False))
        a = a.withColumns({f"{name}_class": metrics.classification(truth, F.col(name)), f"{name}_origin": metrics.origin(truth, F.col(name), pairs, yes)})
    missed = {n: audit.unmatched(positives, stages.explode_pairs(r.stage1, strict=False), PAIR_KEY) for n, r in sides.items()}
    for name in sides:
        out[f"{name}_origins"] = a.where(F.col(f"{name}_class").isin("FP", "FN")).groupBy(f"{name}_class", f"{name}_origin").agg(F.count("*").alias("issues"))
    order = F.array_position(F.array(*map(F.lit, ("FP", "FN", "TP"))), F.col("optimized_class"))
    out |= {"audit": a.orderBy(F.when(order > 0, order).when(F.col("optimized_class") == "TN", 9).otherwise(5), *KEY), "divergences": a.where(~F.col("baseline").eqNullSafe(F.col("optimized"))), "new_misses": missed["optimized"].exceptAll(missed["baseline"])}
    saved = F.lit(None).cast("double") if baseline.total_tokens is None or optimized.total_tokens is None else F.lit(float(baseline.total_tokens - optimized.total_tokens))
    facts = out["new_misses"].agg(F.count("*").alias("new")).join(F.broadcast(out["optimized_recall"].select("recall")))
    gates = facts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), g.alias("state")) for n, g in (("no_new_misses", metrics.gate(F.col("new"), F.col("new") == 0)), ("recall", metrics.gate(F.col("recall"), F.col("recall") >= 0.95)), ("tokens_saved", metrics.gate(saved, saved > 0)))])).alias("x")).select("x.*")
    return out | {"gates": gates, "approved": gates.agg(F.bool_and(F.col("state") == "true").alias("approved"))}


def token_benchmark(prompts: DataFrame) -> DataFrame:
    """Estimated tokens of prompts (profile, stage, text): distributions, and what each profile saves against ``legacy``."""
    sized = prompts.select("profile", "stage", estimated_tokens(F.col("text")).alias("tokens"))
    figures = metrics.distribution(sized, "tokens", ["profile", "stage"])
    legacy = figures.where("profile = 'legacy'").select("stage", F.col("total").alias("_old"))
    return figures.join(legacy, "stage", "left").withColumn("reduction_percent", F.try_divide(100.0 * (F.col("_old") - F.col("total")), F.col("_old"))).drop("_old")


def retrieval_benchmark(scored: DataFrame, gold: DataFrame, names: Sequence[str], families: Sequence[Sequence[str]], configs: dict[str, retrieval.Config]) -> dict[str, DataFrame]:
    """Shortlists of several configurations against gold pairs: recall in all and by group, fallbacks, choice of a configuration.

    ``scored``: repository, issue_number, scores, lexical, tokens. ``gold``: the key and pattern.
    """
    rows = None
    for name, config in configs.items():
        one = retrieval.shortlist(scored, "scores", "lexical", names, families, config).withColumn("config", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    rows = materialize(rows, "shortlists")
    family = F.array(*[F.struct(F.lit(n).alias("pattern"), F.lit(next((i for i, g in enumerate(families) if n in g), -1)).alias("family")) for n in names])
    kinds = gold.sparkSession.range(1).select(F.explode(family).alias("x")).select("x.*")
    due = rows.select("config", *KEY, "candidates", "reasons", "fallback_used", F.size("candidates").alias("size"), "tokens").join(gold, list(KEY), "left").join(F.broadcast(kinds), "pattern", "left")
    hit = F.array_contains("candidates", F.col("pattern"))
    recall = due.where("pattern is not null").groupingSets([["config"], ["config", "pattern"], ["config", "family"]], "config", "pattern", "family").agg(F.count("*").alias("positives"), F.count_if(hit).alias("hits"), F.bool_and(hit).alias("complete"))
    per_issue = due.groupBy("config", *KEY).agg(F.count_if(F.col("pattern").isNotNull() & ~hit).alias("misses"), F.first("size").alias("size"), F.first("tokens").alias("tokens"), F.first("fallback_used").alias("fell"))
    totals = per_issue.groupBy("config").agg(F.sum("misses").alias("misses"), F.avg("size").alias("mean_shortlist"), F.sum("tokens").alias("tokens"), F.avg(F.col("fell").cast("int")).alias("fallback_rate"))
    placed = F.get(F.col("reasons"), (F.array_position("candidates", F.col("pattern")) - 1).cast("int"))
    mechanisms = metrics.recovery(due.where("pattern is not null").select("config", F.when(hit, placed).alias("reasons")), ["config"])
    why = rows.select("config", F.explode("fallback_reasons").alias("reason")).groupBy("config", "reason").agg(F.count("*").alias("issues"))
    folds = per_issue.withColumn("fold", F.concat_ws("#", *KEY)).where(F.col("misses").isNotNull())
    return {"recall": recall.withColumn("recall", metrics.ratio(F.col("hits"), F.col("positives"))), "totals": totals, "mechanisms": mechanisms, "fallbacks": why, "leave_one_out": metrics.leave_one_out(folds, "fold", "config", "misses", "size", "tokens"), "recommended": metrics.recommend(totals, F.col("misses") == 0, F.col("fallback_rate") > 0, "mean_shortlist", "tokens", "config")}


#: A source of responses: takes requests (custom_id and what they need), returns (custom_id, pos, response).
ResponseSource = Callable[[DataFrame], DataFrame]


def replay(table: DataFrame) -> ResponseSource:
    """Responses that were stored before, by custom_id."""
    return lambda requests: table.join(requests.select("custom_id"), "custom_id", "left_semi")


@dataclass(frozen=True)
class Optimized:
    """What the optimised profile needs: a catalog with its phrases, families and latent model, and both stages' budgets in tokens."""

    entries: requests.Entries
    rules: DataFrame
    model: retrieval.Latent
    families: Sequence[Sequence[str]] = ()
    config: retrieval.Config = retrieval.Config()
    stage1_tokens: int = 3_000
    stage2_tokens: int = 2_000


def run(issues: DataFrame, patterns: Sequence[str], stage1_source: ResponseSource, stage2_source: ResponseSource, done1: DataFrame | None = None, done2: DataFrame | None = None, max_chars: int = 12_000, optimized: Optimized | None = None) -> dict[str, DataFrame]:
    """The two-stage pipeline. What earlier runs finished isn't asked again; each stage's results are stored
    before they are used, as asking twice may give other answers.

    With ``optimized`` requests carry the passages that retrieval over the whole source chose, stage 1 the
    shortlist as ``candidates``; stage 2 keeps the evidence that stage 1 gave. A request whose context can't
    be built is answered like one without a response.
    """
    if optimized:
        o = optimized
        prepared = materialize(requests.prepare_optimized(issues, o.entries, o.rules, o.families, o.model, o.config, o.stage1_tokens, max_chars), "prepared")
    else:
        prepared = prepare(issues, max_chars)
    todo = stages.pending(prepared, done1, KEY) if done1 is not None else prepared
    answered = stages.match_responses(todo, stage1_source(todo))
    first = responses.to_rows(_or_error(responses.normalize_stage1(answered.drop("error", "request_status").withColumn("_lost", F.col("response").isNull()), "response", patterns)))
    names = F.transform("value.candidates", lambda c: c["pattern"])
    first = first.select(*KEY, "issue_key", "custom_id", "request_status", "error", F.col("value.issue_summary").alias("issue_summary"), F.col("value.issue_activity_type").alias("issue_activity_type"),
        F.array_join("value.issue_challenge_categories", "|").alias("issue_challenge_categories"), F.col("value.context_status").alias("context_status"), F.to_json(F.coalesce(names, F.array().cast("array<string>"))).alias("candidates"),
        F.to_json("value.candidates").alias("candidate_details"), F.coalesce(F.size(names), F.lit(0)).alias("candidate_count"), F.when(F.col("input_truncated"), "yes").otherwise("no").alias("input_truncated"))
    stage1 = materialize(stages.upsert(done1, first, KEY) if done1 is not None else first, "stage1")
    pairs = stages.explode_pairs(stage1)
    due = stages.pending(pairs, done2) if done2 is not None else pairs
    if optimized:
        asked = requests.stage2_contexts(due, prepared.select(*KEY, "artifact_type", "source_sections"), stage1, optimized.entries, optimized.stage2_tokens)
        asked = materialize(asked.select(*due.columns, "artifact_text", "artifact_type"), "contexts")
    else:
        asked = due.join(prepared.select(*KEY, "artifact_text", "artifact_type"), list(KEY))
    asked = asked.withColumn("custom_id", stable_id("s2", F.col("repository"), F.col("issue_number"), F.col("pattern")))
    answered = stages.match_responses(asked, stage2_source(asked))
    second = responses.to_rows(_or_error(responses.normalize_stage2(answered.drop("error", "request_status").withColumn("_lost", F.col("response").isNull()), "response", patterns)))
    v = F.col("value")
    confidence = stage2_confidence(v["verdict"], v["evidence_text"], v["false_friend_detected"], v["adoption_status"], v["mechanism_match"], v["scope_match"], v["focus_match"])
    second = second.select(*PAIR_KEY, "custom_id", F.col("candidate_pos").alias("pair_pos"), "request_status", "error", v["verdict"].alias("verdict"), v["evidence_text"].alias("evidence_text"),
        F.array_join(remap_locations(v["evidence_location"], F.col("artifact_type")), "|").alias("evidence_location"), v["adoption_status"].alias("adoption_status"), v["false_friend_detected"].alias("false_friend_detected"),
        F.array_join(v["overlap_with"], "|").alias("overlap_with"), F.when(v.isNotNull(), confidence).alias("confidence"), literal_match(F.coalesce(v["evidence_text"], F.lit("")), F.col("artifact_text")).alias("evidence_is_literal"))
    stage2 = materialize(stages.upsert(done2, second, PAIR_KEY) if done2 is not None else second, "stage2")
    return {"stage1": stage1, "stage2": stage2, "issues": rollup.rollup(stage1, stage2, issues), "integrity": stages.integrity(pairs, stage2)}


def _or_error(df: DataFrame) -> DataFrame:
    return df.withColumn("error", F.when(F.col("_lost"), F.lit("no response")).otherwise(F.col("error"))).drop("_lost")


def quality_checks(stage2: DataFrame) -> DataFrame:
    """(check, passed): not everything is of high confidence, and positive verdicts have evidence."""
    good = F.col("request_status") == SUCCEEDED
    facts = stage2.agg(metrics.ratio(F.count_if(good & (F.col("confidence") == "high")), F.count_if(good)).alias("high"), F.count_if(good & F.col("verdict").isin("yes", "uncertain") & (F.coalesce("evidence_text", F.lit("")) == "")).alias("bare"))
    return facts.select(F.explode(F.array(F.struct(F.lit("high_share").alias("check"), (F.coalesce("high", F.lit(0.0)) < 0.8).alias("passed")), F.struct(F.lit("evidence_given").alias("check"), (F.col("bare") == 0).alias("passed")))).alias("x")).select("x.*")


def fallback_report(actual: DataFrame, without: DataFrame, gold: DataFrame) -> DataFrame:
    """Per reason to fall back: issues affected, entries added, gold pairs protected and tokens spent, against the
    shortlists of a configuration that doesn't fall back. Both tables: the key, candidates, fallback_reasons, tokens."""
    both = actual.join(without.select(*KEY, F.col("candidates").alias("_other"), F.col("tokens").alias("_tokens")), list(KEY))
    both = both.select(*KEY, "fallback_reasons", F.array_except("candidates", "_other").alias("added"), (F.col("tokens") - F.col("_tokens")).alias("extra"))
    saved = both.select(*KEY, F.explode("added").alias("pattern")).join(gold.select(*PAIR_KEY).distinct(), list(PAIR_KEY), "left_semi").groupBy(*KEY).agg(F.count("*").alias("protected"))
    rows = both.join(saved, list(KEY), "left").select(F.explode("fallback_reasons").alias("reason"), "added", "extra", F.coalesce("protected", F.lit(0)).alias("protected"))
    return rows.groupBy("reason").agg(F.count("*").alias("issues"), F.sum("protected").alias("protected"), F.sum(F.size("added")).alias("added"), F.sum("extra").alias("tokens"))
