"""Two-stage execution as set operations: pending work, responses, results that replace earlier ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_multivalue
from ..scratch import materialize
from ..sizes import dealt
from ..types import ERRORED, KEY, PAIR_KEY, SUCCEEDED
from .audit import duplicate_keys, require
from .responses import known_name


def explode_pairs(stage1: DataFrame, strict: bool = True, names: Sequence[str] = ()) -> DataFrame:
    """(repository, issue_number, pattern, candidate_pos) of the succeeded issues' JSON lists of candidates.

    ``strict``: a cell that is no JSON list, or names a pattern twice, is an error. Else the request's
    status doesn't matter, a cell that is no JSON list is one of names between bars or semicolons, names
    take the form they have in ``names`` (as they are where none is given or known), and repeats count once.
    """
    rows = stage1.where(F.coalesce(F.col("request_status"), F.lit(SUCCEEDED)) == SUCCEEDED) if strict and "request_status" in stage1.columns else stage1
    parsed = rows.withColumn("_c", F.from_json("candidates", "array<string>"))
    if strict:
        require(parsed.where("_c is null").select(*KEY, "candidates"), "candidates are no JSON list")
    if not strict:
        listed = F.coalesce("_c", F.when(F.substring(F.trim("candidates"), 1, 1) != "[", split_multivalue(F.col("candidates"))))
        clean = F.filter(F.transform(listed, lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != ""))
        parsed = parsed.withColumn("_c", F.transform(clean, lambda v: F.coalesce(known_name(v, names), v)) if names else clean)
    pairs = parsed.select(*KEY, F.posexplode("_c").alias("candidate_pos", "pattern"))
    if strict:
        require(duplicate_keys(pairs, PAIR_KEY), "candidates named twice")
        return pairs.select(*PAIR_KEY, "candidate_pos")
    return pairs.groupBy(*PAIR_KEY).agg(F.min("candidate_pos").alias("candidate_pos"))


def pending(expected: DataFrame, results: DataFrame, key: Sequence[str] = PAIR_KEY) -> DataFrame:
    """What has no succeeded result yet."""
    done = results.where(F.coalesce(F.col("request_status"), F.lit(SUCCEEDED)) == SUCCEEDED) if "request_status" in results.columns else results
    return expected.join(done, list(key), "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """``old`` without the keys of ``new``, and ``new``; columns that one lacks are null."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def match_responses(requests: DataFrame, responses: DataFrame, id_column: str = "custom_id", pos: str = "pos") -> DataFrame:
    """Each request with its first response; a request without one has request_status errored.

    Responses lacking all ids are matched by place, if there are as many of them as requests (both need
    ``pos``). The responses are stored first, so that their source runs once.
    """
    responses = materialize(responses, "answers")  # a source that is asked twice may give other answers
    named = responses.where(F.col(id_column).isNotNull() & (F.col(id_column) != ""))
    if named.isEmpty() and not responses.isEmpty():
        if requests.count() != responses.count():
            return requests.withColumns({"request_status": F.lit(ERRORED), "error": F.lit("responses can't be matched")})
        joined = requests.join(responses.drop(id_column), pos, "left")
    else:
        first = named.withColumn("_n", F.row_number().over(Window.partitionBy(id_column).orderBy(pos))).where("_n = 1").drop("_n", pos)
        joined = requests.join(first, id_column, "left")
    lost = F.col("response").isNull()
    error = F.col("error") if "error" in joined.columns else F.lit("")
    return joined.withColumns({"request_status": F.when(lost, ERRORED).otherwise(SUCCEEDED), "error": F.when(lost, F.lit("no response")).otherwise(error)})


def integrity(expected: DataFrame, results: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """One row: expected, completed, missing, extra, failed and repeated pairs, and OK or FAILED.

    One full outer join of the two key sets serves all counts.
    """
    ok = F.count_if(F.coalesce(F.col("request_status"), F.lit(SUCCEEDED)) == SUCCEEDED)
    have = results.groupBy(*PAIR_KEY).agg(F.count("*").alias("n"), ok.alias("good"))
    want = expected.select(*PAIR_KEY).distinct().withColumn("wanted", F.lit(True))
    both = want.join(have, list(PAIR_KEY), "full")
    wanted, good = F.coalesce("wanted", F.lit(False)), F.coalesce("good", F.lit(0))
    counts = both.agg(
        F.count_if(wanted).alias("expected_pairs"), F.count_if(wanted & (good > 0)).alias("completed_pairs"), F.count_if(wanted & (good == 0)).alias("missing_pairs"),
        F.count_if(~wanted & (good > 0)).alias("extra_pairs"), F.count_if((good == 0) & (F.coalesce("n", F.lit(0)) > 0)).alias("failed_pairs"), F.count_if(good > 1).alias("repeated_pairs"),
    )
    clean = (F.col("missing_pairs") == 0) & (F.col("extra_pairs") == 0) & (F.col("failed_pairs") == 0) & (F.col("repeated_pairs") == 0)
    return counts.withColumn("status", F.when(clean, "OK").otherwise("FAILED"))


def funnel(issues: DataFrame, pairs: DataFrame, final: DataFrame) -> DataFrame:
    """One row: distinct issues at each stage, and where pair verdicts and issue results disagree."""
    per = dealt(pairs, *KEY).groupBy(*KEY).agg(F.bool_or((F.col("request_status") == SUCCEEDED) & (F.col("verdict") == "yes")).alias("_yes"))
    end = final.groupBy(*KEY).agg(F.bool_or(F.col("relevant_to_pattern_study") == "yes").alias("_final"))
    joined = issues.select(*KEY, "candidate_count").join(per, list(KEY), "full").join(end, list(KEY), "full")
    yes, fin = F.coalesce("_yes", F.lit(False)), F.coalesce("_final", F.lit(False))
    flags = {"with_candidates": F.coalesce(F.col("candidate_count"), F.lit(0)) > 0, "with_pairs": F.col("_yes").isNotNull(), "with_yes": yes, "final_yes": fin, "yes_not_final": yes & ~fin, "final_not_yes": fin & ~yes}
    # a row an issue first: counts of distinct issues would spread each row over as many as there are counts
    each = dealt(joined, *KEY, like=pairs).groupBy(*KEY).agg(*[F.bool_or(v).alias(k) for k, v in flags.items()])
    return each.agg(F.count("*").alias("issues"), *[F.count_if(F.col(k)).alias(k) for k in flags])


def pack_requests(requests: DataFrame, run: str, pos: str, size: str, max_items: int = 250, max_bytes: int = 18_000_000) -> DataFrame:
    """Add ``batch`` (from 0): greedily filled in the order of ``pos`` up to a count and a size (two bytes each batch, one each request).

    Filling is sequential, so each ``run`` of requests folds as one array of small structs: a run is one
    submission, not a corpus. The fold keeps the batches' first places only, and each request takes the
    last one before it, so the work is linear in a run. ``pos`` tells the requests of a run apart. A
    request that alone is too large is an error.
    """
    require(requests.where(F.col(size) + 1 > max_bytes).select(run, pos, size), "requests larger than a batch")
    items = requests.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), (F.col(size) + 1).alias("s")))).alias("a"))
    kind = dict(requests.dtypes)[pos]
    start = F.expr(f"named_struct('n', 0, 'u', 2L, 'out', cast(array() as array<{kind}>))")

    def step(a, x):
        new = (F.size(a["out"]) == 0) | (a["n"] >= max_items) | (a["u"] + x["s"] > max_bytes)
        return F.struct(F.when(new, 1).otherwise(a["n"] + 1).alias("n"), F.when(new, 2 + x["s"]).otherwise(a["u"] + x["s"]).cast("long").alias("u"), F.when(new, F.concat(a["out"], F.array(x["p"]))).otherwise(a["out"]).alias("out"))

    firsts = items.select(run, F.posexplode(F.aggregate("a", start, step, lambda a: a["out"])).alias("_batch", pos))
    so_far = Window.partitionBy(run).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return requests.join(firsts, [run, pos], "left").withColumn("batch", F.last("_batch", ignorenulls=True).over(so_far)).drop("_batch")


def reusable_job(jobs: DataFrame, requests: DataFrame, model: str) -> DataFrame:
    """The newest unconsumed job of ``model`` (job_pos, name, consumed, requests map<id, digest>) that holds every
    request (custom_id, digest) as it is now; empty if none does. A division: no request may be lacking or differ."""
    n = requests.agg(F.count("*").alias("n"))
    rows = jobs.where((F.col("model") == model) & ~F.coalesce(F.col("consumed"), F.lit(False))).select("job_pos", "name", F.explode("requests").alias("custom_id", "digest"))
    held = rows.join(requests, ["custom_id", "digest"], "left_semi").groupBy("job_pos", "name").agg(F.count_distinct("custom_id").alias("held"))
    return held.join(F.broadcast(n), F.col("held") == F.col("n")).select("job_pos", "name").orderBy(F.desc("job_pos")).limit(1)


def progress(results: DataFrame, id_column: str = "custom_id") -> DataFrame:
    """(id, state) of every result: completed if any try succeeded, else failed. The result table is the only record."""
    ok = F.bool_or(F.coalesce(F.col("request_status"), F.lit(SUCCEEDED)) == SUCCEEDED)
    return results.groupBy(F.col(id_column).alias("id")).agg(F.when(ok, "completed").otherwise("failed").alias("state"))


def run_status(stage1: DataFrame, stage2: DataFrame, issues: DataFrame, expected_issues: int | None = None) -> DataFrame:
    """(part, value, rows): issues and pairs by status, pairs by verdict, results by relevance, and what is pending.

    Pending is null where the expected number isn't known, and never below zero.
    """
    count = lambda df, part, c: df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("rows")).select(F.lit(part).alias("part"), "value", "rows")
    done = lambda df: df.where(F.col("request_status") == SUCCEEDED)
    pairs = explode_pairs(stage1, strict=False)
    left = pending(pairs, stage2).agg(F.count("*").alias("rows")).select(F.lit("pending").alias("part"), F.lit("pairs").alias("value"), "rows")
    open_issues = done(stage1).agg(F.greatest(F.lit(0).cast("long"), F.lit(expected_issues).cast("long") - F.count("*")).alias("rows"))
    open_issues = open_issues.select(F.lit("pending").alias("part"), F.lit("issues").alias("value"), F.when(F.lit(expected_issues is not None), F.col("rows")).alias("rows"))
    out = count(stage1, "stage1", "request_status").unionByName(count(stage2, "stage2", "request_status")).unionByName(count(done(stage2), "verdict", "verdict"))
    return out.unionByName(count(issues, "relevance", "relevant_to_pattern_study")).unionByName(left).unionByName(open_issues)
