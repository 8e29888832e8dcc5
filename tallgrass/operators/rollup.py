"""Pair results rolled up to issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import weakest
from ..functions.text import clean_scalar
from ..sizes import dealt
from ..types import ISSUE_COLUMNS, KEY, PASSED_ON


def ordered(pos: Column, value: Column, when: Column | None = None) -> Column:
    """Aggregate: the values in the order of ``pos`` (with those where ``when`` doesn't hold left out)."""
    row = F.struct(pos.alias("p"), value.alias("v"))
    return F.transform(F.sort_array(F.collect_list(row if when is None else F.when(when, row))), lambda x: x["v"])  # array_sort compares by an expression


def joined_unique(values: Column) -> Column:
    return F.array_join(F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != ""))), "|")


def pair_groups(pairs: DataFrame, pos: str = "pair_pos") -> DataFrame:
    """One row per issue of the pair results; lists are in ``pos`` order."""
    p, verdict = F.col(pos), F.coalesce("verdict", F.lit(""))
    good = F.coalesce(F.col("request_status") == "succeeded", F.lit(False))
    telling = good & (verdict != "no")
    lists = {"adoption_status": "statuses", "evidence_text": "evidence", "evidence_location": "locations", "overlap_with": "overlaps", "confidence": "confidences"}
    return dealt(pairs, *KEY).groupBy(*KEY).agg(
        *[ordered(p, F.col("pattern"), good & (verdict == v)).alias(f"_{v}") for v in ("yes", "uncertain", "insufficient_context")],
        *[ordered(p, clean_scalar(F.col(c)), telling).alias(f"_{a}") for c, a in lists.items()],
        F.bool_or(good & (F.col("false_friend_detected") == "yes")).alias("_friend"),
        F.bool_or(good & (F.col("false_friend_detected") == "uncertain")).alias("_unsure"),
        F.count_if(good).alias("_good"),
        F.count_if(~good).alias("_bad"),
    )


def rollup(stage1: DataFrame, pairs: DataFrame, inputs: DataFrame | None = None, pos: str = "pair_pos", input_pos: str | None = None) -> DataFrame:
    """Issue results: one row per row of ``stage1``.

    An error anywhere makes the issue a pipeline_error before all else; then yes, uncertain and
    insufficient_context of any pair count in that order. Input rows lend their metadata, of several with
    one key the last by ``input_pos``. All joins are on the key, so one shuffle serves the grouping too.
    """
    for c in ("context_status", "issue_summary", "candidate_count", "input_truncated", "issue_challenge_categories", "issue_activity_type", "issue_key"):
        if c not in stage1.columns:
            stage1 = stage1.withColumn(c, F.lit({"candidate_count": 0, "input_truncated": "no"}.get(c, "")))
    keyed = lambda df: df.withColumns({k: clean_scalar(F.col(k)) for k in KEY})
    s = keyed(stage1).join(pair_groups(keyed(pairs), pos), list(KEY), "left")
    have = set(inputs.columns) if inputs is not None else set()
    meta = [c for c in (*PASSED_ON, "repository_full_name", "repository_category", "repository_category_canonical") if c in have]
    if inputs is not None:
        last = F.max_by(F.struct(*meta, F.lit(True).alias("_there")), F.col(input_pos) if input_pos else F.lit(0)).alias("_m")
        s = s.join(dealt(keyed(inputs), *KEY, like=pairs).groupBy(*KEY).agg(last), list(KEY), "left")
    m = lambda c, other: F.when(F.col("_m._there"), clean_scalar(F.col(f"_m.{c}"))).otherwise(other) if c in meta else other
    none, ok = F.array().cast("array<string>"), F.col("request_status") == "succeeded"
    lists = {c: F.coalesce(F.col(f"_{c}"), none) for c in ("yes", "uncertain", "insufficient_context", "statuses", "evidence", "locations", "overlaps", "confidences")}
    good, bad = F.coalesce("_good", F.lit(0)), F.coalesce("_bad", F.lit(0))
    some = lambda c: F.size(lists[c]) > 0
    relevance = (
        F.when(~F.coalesce(ok, F.lit(False)) | (bad > 0), "pipeline_error").when(some("yes"), "yes").when(some("uncertain"), "uncertain")
        .when(some("insufficient_context") | (F.col("context_status") == "insufficient_context"), "insufficient_context").otherwise("no")
    )
    statuses = F.array_distinct(F.filter(lists["statuses"], lambda x: x != ""))
    adoption = F.when(F.size(statuses) == 1, F.get(statuses, F.lit(0))).when(F.size(statuses) > 1, "multiple").when(relevance == "insufficient_context", "insufficient_context").otherwise("not_related")
    blank = F.lit("")
    category = m("repository_category", blank)
    out = {c: m(c, blank) for c in PASSED_ON} | {
        "repository_full_name": m("repository_full_name", F.col("repository")),
        "repository_category": category,
        "repository_category_canonical": m("repository_category_canonical", category),
        "stage1_candidate_count": F.col("candidate_count"),
        "stage2_pair_count": good.cast("long"),
        "pipeline_error_count": (F.when(F.coalesce(ok, F.lit(False)), 0).otherwise(1) + bad).cast("long"),
        "patterns_present": F.array_join(F.concat(lists["yes"], lists["uncertain"], lists["insufficient_context"]), "|"),
        "evidence_text": joined_unique(lists["evidence"]),
        "evidence_location": joined_unique(lists["locations"]),
        "confidence": weakest(lists["confidences"]),
        "insufficient_context": F.when(relevance == "insufficient_context", "yes").otherwise("no"),
        "false_friend_detected": F.when(F.coalesce("_friend", F.lit(False)), "yes").when(F.coalesce("_unsure", F.lit(False)), "uncertain").otherwise("no"),
        "overlapping_patterns": joined_unique(lists["overlaps"]),
        "challenge_categories": clean_scalar(F.col("issue_challenge_categories")),
        "adoption_status": adoption,
        "relevant_to_pattern_study": relevance,
        "annotator_id": blank, "human_notes": blank, "annotation_date": blank,
        "patterns_confirmed": F.array_join(lists["yes"], "|"),
        "patterns_uncertain": F.array_join(lists["uncertain"], "|"),
        "patterns_insufficient_context": F.array_join(lists["insufficient_context"], "|"),
    }
    return s.select(*[out.get(c, F.col(c)).alias(c) for c in ISSUE_COLUMNS])
