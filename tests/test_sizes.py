"""What keeps queries within their limits as tables grow: each step once a row, tasks of a bounded size."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from tallgrass import sizes
from tallgrass.functions.text import once, strip, terms
from tallgrass.operators import catalog, responses, retrieval, rollup, spans, stages
from tallgrass.plans import bindings


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_schema_check_reads_the_json_once(spark):
    schema = {"type": "object", "additionalProperties": False, "required": ["a", "b"], "properties": {"a": {"type": "string", "enum": ["x"]}, "b": {"type": "array", "items": {"enum": ["y"]}}, "c": {"type": "object", "required": ["d"]}}}
    texts = ['{"a":"x","b":["y"]}', '{"a":"z","b":["z"],"c":{},"e":1}', "[]", None, '{"a":{},"b":{}}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    told = df.select("i", responses.schema_errors(responses.json_object(F.col("t")), schema).alias("e"))
    assert plan_of(told).count("from_json") == 2  # one for the object, one for the list
    got = {r["i"]: r["e"] for r in told.collect()}
    assert got[0] == [] and got[2] == got[3] == ["$.a: missing", "$.b: missing"]
    assert got[1] == ["$: unknown keys", "$.a: not allowed", "$.b: item not allowed", "$.c.d: missing"]
    assert got[4] == ["$.a: no string", "$.a: not allowed", "$.b: no array"]


def test_a_wire_answer_is_read_once(spark):
    text, error = responses.decode_wire(F.col("w"), 2, {"A": "X1"})
    plan = plan_of(spark.createDataFrame([("{}",)], "w string").coalesce(1).select(text.alias("t"), error.alias("e")))
    assert plan.count("from_json") == 4  # a short and a long form in each of two columns


def test_strip_takes_all_white_space(spark):
    white = "".join(c for c in map(chr, range(1, 0x3001)) if not 0xD800 <= ord(c) <= 0xDFFF)
    df = spark.createDataFrame([(c,) for c in white], "c string").withColumn("t", F.concat("c", F.lit("a"), "c", F.lit("b\n"), "c"))
    assert df.where(strip(F.col("t")) != F.regexp_replace("t", r"(?U)^\s+|\s+$", "")).count() == 0
    assert [r["x"] for r in spark.createDataFrame([(None,), (" ",)], "t string").coalesce(1).select(strip(F.col("t")).alias("x")).collect()] == [None, ""]


def test_once_is_f_of_the_value(spark):
    df = spark.createDataFrame([(None,), (2,)], "n int").coalesce(1)
    assert [r["x"] for r in df.select(once(F.col("n"), lambda n: F.coalesce(n * n, F.lit(-1))).alias("x")).collect()] == [-1, 4]


def test_related_names_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(catalog, "_BLOCK", 7)
    table = [(f"n{i % 9}" if i % 10 else None, f"c{i % 2}", ["s0", "s1", "", None][i % 4], f"f{i % 3}" if i % 5 else None, i // 2) for i in range(60)]
    df = spark.createDataFrame(table, "name string, c string, s string, f string, o int")
    for family in (None, "f"):
        keys = [{("s", r[1], r[2]) if r[2] else ("c", r[1])} | ({("f", r[3])} if family and r[3] else set()) for r in table]
        want = {}
        for a, x in zip(table, keys, strict=True):
            for b, y in zip(table, keys, strict=True):
                if a[0] and b[0] and a[0] != b[0] and x & y:
                    want.setdefault(a[0], set()).add((b[4], b[0]))
        got = {r["name"]: r["related"] for r in catalog.related(df, "name", "c", "s", "o", family).collect()}
        assert got == {n: "|".join(x for _, x in sorted(v)) for n, v in want.items()}
    repeated = spark.createDataFrame([(f"n{i % 2}", "c", "s", i) for i in range(400)], "name string, c string, s string, o int")
    plan = plan_of(catalog.related(repeated, "name", "c", "s", "o"))
    assert plan.count("Join") == 1 and plan.count("collect_set") == 1  # packed entries meet distinct names, not entries entries


def test_tasks_grow_with_the_table(spark, tmp_path):
    spark.range(0, 300_000, 1, 1).withColumn("t", F.sha2(F.col("id").cast("string"), 256)).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).select("t")
    size = sizes.read_bytes(df)
    assert size > 1_000_000 and sizes.tasks(df, size / 1_000_000 / 40) in (40, 41) and sizes.tasks(df, 1e6) == spark.sparkContext.defaultParallelism
    assert sizes.tasks(df.union(df), size / 1_000_000 / 40) in (80, 81)
    assert sizes.tasks(spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "a int")) >= spark.sparkContext.defaultParallelism


def test_texts_are_dealt_by_their_size(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "tasks", lambda df: 37)
    docs = spark.createDataFrame([(1, "alpha beta"), (1, "beta"), (2, "gamma")], "k int, t string").coalesce(1)
    scores = retrieval.tfidf_scores(docs, "k", "t", spark.createDataFrame([("a", "alpha beta"), ("b", "beta delta")], "n string, d string"), "n", "d")
    assert any("RepartitionByExpression" in x and "37" in x for x in plan_of(scores).splitlines())
    assert {(r["k"], r["n"]) for r in scores.collect()} == {(1, "a"), (1, "b")}


def test_terms_fold_a_text_twice_at_most(spark):
    df = spark.createDataFrame([(t,) for t in ("camelCase the ÀÉ Straße", "ﬁne Żółw ﬀ Σςx", "a b cc", None, "")], "t string").coalesce(1)
    plan = plan_of(df.select(terms(F.col("t")).alias("x")))
    assert plan.count("translate(") + plan.count("stringtranslate(") <= 2
    got = [r["x"] for r in df.select(terms(F.col("t")).alias("x")).collect()]
    assert [got[i] for i in (0, 2, 3, 4)] == [["camel", "case", "ae", "strasse"], ["cc"], [], []]
    assert set(got[1]) == spans.word_set("ﬁne Żółw ﬀ Σςx")


def test_latent_scores_make_no_text_of_python(spark):
    catalog_ = spark.createDataFrame([("a", "alpha beta beta"), ("b", "beta delta"), ("c", "gamma")], "n string, d string")
    model = retrieval.fit_latent(catalog_, "n", "d")
    batch = pa.array([["beta", "zz", "alpha", "beta"], [], ["zz"], None], pa.list_(pa.string()))
    got = retrieval._scores(batch, model).to_pylist()
    assert got[1] == got[2] == got[3] == [0.0, 0.0, 0.0] and got[0][0] == max(got[0])
    assert retrieval._scores(batch.slice(2), model).to_pylist() == got[2:] and retrieval._scores(batch.slice(0, 0), model).to_pylist() == []


def test_small_rows_are_dealt_by_size(spark, tmp_path):
    spark.range(0, 400_000, 1, 1).select(F.col("id").alias("event_id"), F.sha2(F.col("id").cast("string"), 512).alias("t")).write.parquet(str(tmp_path / "events.parquet"))
    dealt = bindings.table(spark, str(tmp_path), "events")
    assert dealt.rdd.getNumPartitions() > 4 * spark.sparkContext.defaultParallelism


def test_an_outcome_reads_only_what_is_there(spark):
    df = spark.createDataFrame([(i, a) for i, a in enumerate([None, "{", "[]", '{"text":" a "}', '{"candidates":[{"finishReason":"x.stop","content":{"parts":[{"text":"b"},{"text":"c"}]}}],"usageMetadata":{"promptTokenCount":2,"thoughtsTokenCount":"3"},"modelVersion":"m"}', '{"choices":null,"candidates":[]}'])], "i int, a string").coalesce(1)
    told = df.select("i", responses.outcome(F.col("a")).alias("o"))
    assert plan_of(told).count("get_json_object") <= 80
    got = {r["i"]: r["o"] for r in told.collect()}
    assert [got[i]["error"] for i in range(6)] == ["no answer", "no answer", "no answer", None, None, "no text"]
    assert got[3]["text"] == "a" and (got[4]["text"], got[4]["stop_reason"], got[4]["input_tokens"], got[4]["thoughts_tokens"], got[4]["model"]) == ("bc", "STOP", 2, 3, "m")


def test_pairs_are_dealt_by_issue(spark, monkeypatch):
    monkeypatch.setattr(sizes, "tasks", lambda df, megabytes=8: 23)
    pairs = spark.createDataFrame([("r", "1", "P", 1, "succeeded", "yes"), ("r", "1", "Q", 0, "succeeded", "no"), ("r", "3", "P", 0, "errored", "no")], "repository string, issue_number string, pattern string, pair_pos int, request_status string, verdict string").coalesce(1)
    for c in ("adoption_status", "evidence_text", "evidence_location", "overlap_with", "confidence", "false_friend_detected"):
        pairs = pairs.withColumn(c, F.lit("x"))
    assert "23" in next(x for x in plan_of(rollup.pair_groups(pairs)).splitlines() if "RepartitionByExpression" in x)
    issues = spark.createDataFrame([("r", "1", 2), ("r", "1", 0), ("r", "2", None)], "repository string, issue_number string, candidate_count int").coalesce(1)
    final = spark.createDataFrame([("r", "2", "yes"), ("r", "1", "no"), ("r", "4", "yes")], "repository string, issue_number string, relevant_to_pattern_study string").coalesce(1)
    told = stages.funnel(issues, pairs, final)
    assert "Expand" not in plan_of(told)  # no row for each of the counts
    assert told.first().asDict() == {"issues": 4, "with_candidates": 1, "with_pairs": 2, "with_yes": 1, "final_yes": 2, "yes_not_final": 1, "final_not_yes": 2}
