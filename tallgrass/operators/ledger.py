"""Ledgers of model calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENS = tuple(f"{kind}_tokens" for kind in "input output total thoughts cached_input".split())
REPLAY = ("batch_name", "stage", "repository", "issue_number", "pattern")


def final_attempts(calls: DataFrame, request: str = "logical_request_id", attempt: str = "attempt_number", pos: str = "pos") -> DataFrame:
    """The last row of each logical request: highest attempt, then later in the ledger. An aggregate, so it combines map-side."""
    own = [c for c in calls.columns if c != request]
    last = F.max_by(F.struct(*own), F.struct(F.coalesce(F.col(attempt), F.lit(1)), F.col(pos)))
    return calls.groupBy(request).agg(last.alias("_r")).select(request, "_r.*")


def successful() -> Column:
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return F.coalesce(F.col("response_status") == "succeeded", F.lit(False)) & empty("error")


def summarize(calls: DataFrame, wall_seconds: float | None = None, input_price: float | None = None, output_price: float | None = None, baseline_total: int | None = None, pos: str = "pos") -> DataFrame:
    """One row of totals. Tokens nobody measured are null, not 0; costs and savings need every call measured."""
    stage = lambda s: F.when(F.col("stage") == s, F.col("input_tokens"))
    figures = [F.count("*").alias("calls"), ((F.count("*") > 0) & (F.count_if(F.col("total_tokens").isNull()) == 0)).alias("usage_complete")]
    figures += [x for t in TOKENS for x in (F.sum(t).alias("total_" + t.removeprefix("total_")), F.count(t).alias(f"{t}_measured_calls"))]
    for s in ("stage1", "stage2"):
        figures += [F.avg(stage(s)).alias(f"mean_input_tokens_{s}"), F.median(stage(s)).alias(f"median_input_tokens_{s}"), F.percentile(stage(s), 0.95).alias(f"p95_input_tokens_{s}")]
    figures += [F.sum("elapsed_seconds").alias("measured_call_elapsed_seconds"), F.median("elapsed_seconds").alias("median_latency_seconds"), F.percentile("elapsed_seconds", 0.95).alias("p95_latency_seconds")]
    figures += [F.count_if(F.coalesce("attempt_number", F.lit(1)) > 1).alias("retries")]
    rows = calls.agg(*figures)
    last = final_attempts(calls, pos=pos).withColumn("_ok", successful())
    wall = F.lit(wall_seconds).cast("double")
    logical = last.agg(
        F.count("*").alias("logical_calls"), F.count_if("_ok").alias("successful_calls"), F.count_if(~F.col("_ok")).alias("failed_calls"), F.count_distinct(F.struct("repository", "issue_number")).alias("issues"),
        *[x for s in ("stage1", "stage2") for x in (F.count_if(F.col("stage") == s).alias(f"{s}_calls"), F.count_if((F.col("stage") == s) & F.col("_ok")).alias(f"{s}_successful_calls"))],
    )
    both = rows.join(F.broadcast(logical))  # one row each
    per_hour = lambda c: F.try_divide(F.col(c) * 3600.0, wall)
    both = both.withColumns({"requests_per_hour": per_hour("successful_calls"), "issues_per_hour": per_hour("issues"), "stage1_calls_per_hour": per_hour("stage1_successful_calls"), "stage2_calls_per_hour": per_hour("stage2_successful_calls")})
    complete, zero = F.col("usage_complete"), lambda c: F.coalesce(F.col(c), F.lit(0))
    cost = F.lit(None).cast("double") if input_price is None or output_price is None else F.when(complete, (zero("total_input_tokens") * input_price + (zero("total_output_tokens") + zero("total_thoughts_tokens")) * output_price) / 1e6)
    saved = F.lit(None).cast("long") if not baseline_total else F.when(complete, F.lit(baseline_total) - F.col("total_tokens"))
    return both.withColumns({"estimated_cost_if_api": cost, "tokens_saved_vs_baseline": saved, "percentage_saved_vs_baseline": F.try_divide(100.0 * saved, F.lit(baseline_total or None).cast("double"))})


def append_replay(old: DataFrame, new: DataFrame, identity: Sequence[str] = REPLAY) -> DataFrame:
    """``old`` and those rows of ``new`` that no batch row of ``old`` repeats; rows without a batch always count."""
    seen = old.where("batch_name is not null").select(*identity).distinct()
    same = None
    fresh, known = new.alias("n"), seen.alias("s")
    for c in identity:
        term = F.col(f"n.{c}").eqNullSafe(F.col(f"s.{c}"))
        same = term if same is None else same & term
    return old.unionByName(fresh.join(known, same, "left_anti"), allowMissingColumns=True)
