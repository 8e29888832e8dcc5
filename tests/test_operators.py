from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallgrass.operators import audit, catalog, ledger, metrics, prepare, requests, responses, retrieval, rollup, spans, stages, vocab
from tallgrass.plans import composites
from tallgrass.sources import files, sinks
from tallgrass.streaming import ledger as stream
from tallgrass.types import PAIR_KEY


def rows(df):
    return sorted(tuple(r) for r in df.collect())


PAIR = "repository string, issue_number string, pattern string, pair_pos int, request_status string, verdict string, adoption_status string, false_friend_detected string, evidence_text string, evidence_location string, overlap_with string, confidence string"


def pair(pattern, pos, verdict, status="succeeded", adoption="conceptual_discussion", friend="no", evidence="e", confidence="high", issue="1"):
    return ("r", issue, pattern, pos, status, verdict, adoption, friend, evidence, "body", "", confidence)


def stage1(spark, *issues, status="succeeded"):
    return spark.createDataFrame([("r", i, f"r#{i}", status, "s", 2) for i in issues], "repository string, issue_number string, issue_key string, request_status string, issue_summary string, candidate_count int")


def test_rollup_rules(spark):
    data = [
        pair("Oracle", 0, "uncertain"), pair("Proxy", 1, "yes", adoption="problem_with_implementation", confidence="medium"), pair("Vote", 2, "no", friend="yes", evidence="never"),
        pair("A", 0, "no", issue="2"), pair("B", 0, "yes", issue="3"), pair("C", 1, None, "errored", issue="3"), pair("D", 0, "insufficient_context", adoption="insufficient_context", issue="4"),
    ]
    pairs = spark.createDataFrame(data, PAIR)
    for p in (pairs, pairs.repartition(7, "pattern").orderBy(F.rand(3))):
        out = {r["issue_number"]: r.asDict() for r in rollup.rollup(stage1(spark, "1", "2", "3", "4", "5"), p).collect()}
        one = out["1"]
        assert (one["relevant_to_pattern_study"], one["patterns_confirmed"], one["patterns_uncertain"], one["adoption_status"]) == ("yes", "Proxy", "Oracle", "multiple")
        assert (one["patterns_present"], one["confidence"], one["false_friend_detected"], one["evidence_text"], one["stage2_pair_count"], one["pipeline_error_count"]) == ("Proxy|Oracle", "medium", "yes", "e", 3, 0)
        assert [out[i]["relevant_to_pattern_study"] for i in "2345"] == ["no", "pipeline_error", "insufficient_context", "no"]
        assert out["3"]["pipeline_error_count"] == 1 and out["5"]["adoption_status"] == "not_related" and out["2"]["patterns_present"] == ""


def test_rollup_of_no_pairs_and_last_input(spark):
    inputs = spark.createDataFrame([("r", "1", "old", 1), ("r", "1", " new ", 2)], "repository string, issue_number string, labels string, pos int")
    out = rollup.rollup(stage1(spark, "1", status="errored"), spark.createDataFrame([], PAIR), inputs, input_pos="pos").first()
    assert (out["labels"], out["relevant_to_pattern_study"], out["pipeline_error_count"]) == ("new", "pipeline_error", 1)


def test_assertions(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", " "), ("c", None)], "k string, v string")
    assert rows(audit.duplicate_keys(df, ["k", "v"])) == [("a", "1", 2)]
    assert audit.rows_with_duplicate_keys(df, ["k"]).count() == 2
    assert audit.blank_keys(df, ["v"]).count() == 2
    with pytest.raises(audit.Violation):
        audit.require(audit.blank_keys(df, ["v"]), "blank")
    assert audit.normalized_headers([" Repository​ ", "Issue Number", "﻿ISSUE-TITLE"]) == ["repository", "issue_number", "issue_title"]
    with pytest.raises(audit.Violation):
        audit.normalized_headers(["repository", " Repository "])
    with pytest.raises(audit.Violation):
        audit.one_to_one(df.where("k = 'b'"), df.where("k = 'c'"), ["k"])
    states = spark.createDataFrame([(["a", "a"], ["b"]), (["a"], ["a"]), (["a"], ["b"])], "completed_ids array<string>, failed_ids array<string>")
    assert audit.broken_checkpoints(states).count() == 2
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "name string, value string")
    b = spark.createDataFrame([("x", "1"), ("z", "2")], "name string, value string")
    assert [r["name"] for r in audit.differing_settings(a, b).orderBy("name").collect()] == ["y", "z"]
    assert audit.same_rows(a, a) and not audit.same_rows(a, b)


def test_changes(spark):
    df = spark.createDataFrame([(1, " a\n", None), (2, "b", "c")], "id int, x string, y string")
    out = audit.changes(df, {"x": (F.trim(F.regexp_replace("x", "\n", "")), "trim"), "y": (F.coalesce("y", F.lit("")), "fill")}, ["id"], "s").collect()
    assert [(r["id"], r["column"], r["before_preview"], r["after_preview"]) for r in out] == [(1, "x", " a\\n", "a")]


def test_vocabulary(spark):
    names = vocab.vocabulary(spark, ["Check-Effects", "Vote"])
    df = spark.createDataFrame([("check effects",), ("VOTE",), ("x",), ("",), (None,)], "g string")
    assert rows(vocab.canonicalize(df, "g", names).select(F.coalesce("g", F.lit("null")), F.coalesce("canonical", F.lit("-")), "known")) == [("", "-", False), ("VOTE", "Vote", True), ("check effects", "Check-Effects", True), ("null", "-", False), ("x", "-", False)]
    assert vocab.collisions(spark.createDataFrame([("A-B",), ("A_B",), ("C",)], "canonical string")).count() == 1
    many = spark.createDataFrame([(1, "vote|check_effects|VOTE"), (2, "nope")], "id int, c string")
    assert rows(vocab.canonicalize_multivalue(many, ["id"], "c", names)) == [(1, ["Vote", "Check-Effects"])]
    with pytest.raises(audit.Violation):
        vocab.canonicalize_multivalue(many, ["id"], "c", names, strict=True)


def test_validate_and_prepare(spark):
    df = spark.createDataFrame([("a", "15.0", " t ", "A" * 1000 + "BODY_TAIL", "B" * 1000 + "COMMENT_TAIL", "x")], ["Repository", "Issue Number", "issue_title", "issue_body", "concatenated_comments", "Odd Column"])
    good = prepare.validate_input(df)
    row = good.first()
    assert (row["issue_key"], row["repository_full_name"] if "repository_full_name" in good.columns else "a", row["odd_column"], row["labels"]) == ("a#15", "a", "x", "")
    out = prepare.prepare(good, 700).first()
    assert out["input_truncated"] and "BODY_TAIL" in out["artifact_text"] and "COMMENT_TAIL" in out["artifact_text"]
    with pytest.raises(audit.Violation):
        prepare.validate_input(df.unionByName(df))
    clash = df.withColumn("repository_full_name", F.lit("b"))
    with pytest.raises(audit.Violation):
        prepare.validate_input(clash)


def test_stage_sets(spark):
    s1 = spark.createDataFrame([("r", "1", "succeeded", '["A","B"]'), ("r", "2", "errored", "[]"), ("r", "3", "succeeded", "[]")], "repository string, issue_number string, request_status string, candidates string")
    pairs = stages.explode_pairs(s1)
    assert rows(pairs) == [("r", "1", "A", 0), ("r", "1", "B", 1)]
    for bad in ('["A","A"]', "no", '{"a":1}'):
        broken = spark.createDataFrame([("r", "1", "succeeded", bad)], s1.schema)
        with pytest.raises(audit.Violation):
            stages.explode_pairs(broken)
        assert stages.explode_pairs(broken, strict=False).count() <= 1
    done = spark.createDataFrame([("r", "1", "A", "succeeded"), ("r", "1", "B", "errored"), ("r", "9", "X", "succeeded")], "repository string, issue_number string, pattern string, request_status string")
    assert rows(stages.pending(pairs, done).select("pattern")) == [("B",)]
    report = stages.integrity(pairs, done).first()
    assert (report["expected_pairs"], report["completed_pairs"], report["missing_pairs"], report["extra_pairs"], report["failed_pairs"], report["status"]) == (2, 1, 1, 1, 1, "FAILED")
    new = spark.createDataFrame([("r", "1", "B", "succeeded", 1)], "repository string, issue_number string, pattern string, request_status string, extra int")
    once = stages.upsert(done, new, PAIR_KEY)
    assert once.count() == 3 and rows(stages.upsert(once, new, PAIR_KEY).select(*PAIR_KEY)) == rows(once.select(*PAIR_KEY))


def test_resume_asks_only_for_the_rest(spark):
    expected = spark.range(72).select(F.lit("r").alias("repository"), (F.col("id") % 8).cast("string").alias("issue_number"), F.concat(F.lit("P"), "id").alias("pattern"))
    done = expected.where("cast(substr(pattern, 2) as int) < 51").withColumn("request_status", F.lit("succeeded"))
    assert stages.pending(expected, done).count() == 21


def test_responses_are_matched(spark):
    req = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "custom_id string, pos int")
    res = spark.createDataFrame([("a", 0, "first"), ("a", 1, "second"), ("c", 2, "z")], "custom_id string, pos int, response string")
    assert rows(stages.match_responses(req, res).select("custom_id", "request_status", F.coalesce("response", F.lit("-")))) == [("a", "succeeded", "first"), ("b", "errored", "-"), ("c", "succeeded", "z")]
    blank = spark.createDataFrame([("", i, f"v{i}") for i in range(3)], res.schema)
    assert rows(stages.match_responses(req, blank).select("custom_id", "response")) == [("a", "v0"), ("b", "v1"), ("c", "v2")]
    assert stages.match_responses(req, blank.limit(2)).where("request_status = 'errored'").count() == 3


def test_batches(spark):
    req = spark.createDataFrame([("j", i, 10) for i in range(5)], "run string, pos int, size long")
    assert [r["batch"] for r in stages.pack_requests(req, "run", "pos", "size", 2, 1000).orderBy("pos").collect()] == [0, 0, 1, 1, 2]
    assert [r["batch"] for r in stages.pack_requests(req, "run", "pos", "size", 9, 24).orderBy("pos").collect()] == [0, 0, 1, 1, 2]
    with pytest.raises(audit.Violation):
        stages.pack_requests(req, "run", "pos", "size", 9, 10)


def test_metrics(spark):
    df = spark.createDataFrame([("yes", "yes"), ("yes", "no"), ("no", "yes"), ("no", "no"), ("uncertain", "yes")], "t string, p string")
    m = metrics.binary_metrics(df, "t", "p").first()
    assert (m["tp"], m["tn"], m["fp"], m["fn"], m["precision"], m["recall"], m["f1"]) == (1, 1, 1, 1, 0.5, 0.5, 0.5)
    none = metrics.binary_metrics(df.where("p = 'no'"), "t", "p").first()
    assert none["precision"] is None and none["recall"] == 0 and none["negative_predictive_value"] == 0.5 and none["f1"] is None
    assert metrics.binary_metrics(df.where("t = 'no'"), "t", "p").first()["balanced_accuracy"] is None
    with pytest.raises(audit.Violation):
        metrics.binary_metrics(df, "t", "p", strict=True)
    d = metrics.distribution(spark.createDataFrame([(float(i),) for i in range(1, 21)], "v double"), "v").first()
    assert (d["n"], d["total"], d["median"], round(d["p95"], 6)) == (20, 210.0, 10.5, 19.05)
    empty = metrics.distribution(spark.createDataFrame([], "v double"), "v").first()
    assert empty["n"] == 0 and empty["total"] is None


def test_ledger(spark):
    calls = spark.createDataFrame([
        (0, "stage1", "r", "1", "P", "x", 1, None, None, None, 1.0, "errored", "timeout", None), (1, "stage1", "r", "1", "P", "x", 2, 100, 25, 125, 3.0, "succeeded", "", None), (2, "stage2", "r", "1", "P", "y", 1, 10, 5, 15, 2.0, "succeeded", "", "b1"),
    ], "pos long, stage string, repository string, issue_number string, pattern string, logical_request_id string, attempt_number int, input_tokens long, output_tokens long, total_tokens long, elapsed_seconds double, response_status string, error string, batch_name string").withColumns({"thoughts_tokens": F.lit(None).cast("long"), "cached_input_tokens": F.lit(None).cast("long")})
    s = ledger.summarize(calls, 3600.0, 1.0, 2.0, 1000).first()
    assert (s["calls"], s["usage_complete"], s["total_tokens"], s["total_thoughts_tokens"], s["retries"], s["logical_calls"], s["successful_calls"], s["requests_per_hour"]) == (3, False, 140, None, 1, 2, 2, 2.0)
    assert s["estimated_cost_if_api"] is None and s["tokens_saved_vs_baseline"] is None
    whole = ledger.summarize(calls.where("pos > 0"), None, 1.0, 2.0, 1000).first()
    assert whole["estimated_cost_if_api"] == pytest.approx((110 + 60) / 1e6) and whole["tokens_saved_vs_baseline"] == 860 and whole["requests_per_hour"] is None
    assert ledger.append_replay(calls, calls).count() == 5  # the batch row is a replay, the others aren't


PATTERNS = ["Proxy Contract", "Oracle"]
S2 = dict.fromkeys(("mechanism_match", "scope_match", "focus_match"), True) | dict(
    verdict="YES", evidence_text=" seen ", evidence_location=["Body"], justification="because", adoption_status="implemented existing", false_friend_detected="no",
    pattern_challenge_categories=[], confidence="High", alternative_pattern="", overlap_with=["oracle", "ORACLE"],
)


def normalized(spark, f, payload):
    raw = payload if isinstance(payload, str) or payload is None else json.dumps(payload)
    return f(spark.createDataFrame([(raw,)], "raw string"), "raw", PATTERNS).first()


def test_stage2_responses(spark):
    got = normalized(spark, responses.normalize_stage2, S2)
    assert got["error"] is None
    v = got["value"]
    assert (v["verdict"], v["evidence_text"], v["evidence_location"], v["adoption_status"], v["overlap_with"], v["pattern_challenge_categories"]) == ("yes", "seen", ["body"], "implemented_existing", ["Oracle"], ["none_explicit"])
    down = normalized(spark, responses.normalize_stage2, S2 | {"focus_match": False, "adoption_status": "superficial_mention"})["value"]
    assert down["verdict"] == "uncertain" and down["adoption_status"] == "conceptual_discussion" and down["justification"].startswith("[auto-downgraded yes→uncertain: focus_match ausente] ")
    absent = {k: v for k, v in S2.items() if not k.endswith("_match")}
    assert normalized(spark, responses.normalize_stage2, absent)["value"]["mechanism_match"] is True
    for change, error in [({"adoption_status": "not_related"}, "yes against adoption_status"), ({"verdict": "no"}, "no against adoption_status"), ({"verdict": "perhaps"}, "verdict unknown"), ({"justification": " "}, "justification blank"), ({"evidence_location": []}, "evidence_location empty"), ({"evidence_text": ""}, "evidence_text blank"), ({"overlap_with": ["x"]}, "overlap_with unknown"), ({"verdict": "insufficient_context"}, "insufficient_context against adoption_status")]:
        row = normalized(spark, responses.normalize_stage2, S2 | change)
        assert (row["error"], row["value"]) == (error, None)
    no = normalized(spark, responses.normalize_stage2, S2 | {"verdict": "no", "adoption_status": "not_related", "pattern_challenge_categories": ["other"]})["value"]
    assert no["pattern_challenge_categories"] == []
    for bad in (None, "", "[]", "text", "{"):
        assert normalized(spark, responses.normalize_stage2, bad)["error"] == "no JSON object"


S1 = dict(issue_summary="x", issue_activity_type="Bug Report", issue_challenge_categories=["none_explicit", "migration"], context_status="sufficient")
S1["candidates"] = [dict(zip("pattern evidence_text evidence_location rationale confidence".split(), x)) for x in (("oracle", "e", "body", "r", "low"), ("Oracle", "", "body", "", "low"))]


def test_stage1_responses(spark):
    got = normalized(spark, responses.normalize_stage1, S1)
    assert got["error"] is None and got["value"]["issue_challenge_categories"] == ["migration"] and [c["pattern"] for c in got["value"]["candidates"]] == ["Oracle"]
    assert normalized(spark, responses.normalize_stage1, "```json\n" + json.dumps(S1) + "\n```")["error"] is None
    assert normalized(spark, responses.normalize_stage1, S1 | {"candidates": []})["value"]["candidates"] == []
    for change, error in [({"issue_summary": " "}, "issue_summary blank"), ({"candidates": [S1["candidates"][0] | {"pattern": "zz"}]}, "pattern unknown"), ({"candidates": [S1["candidates"][1]]}, "candidate without evidence_text"), ({"context_status": "?"}, "context_status unknown")]:
        assert normalized(spark, responses.normalize_stage1, S1 | change)["error"] == error


def test_wire(spark):
    short = {responses.WIRE2[k]: v for k, v in S2.items()}
    df = spark.createDataFrame([(json.dumps(short),), (json.dumps(S2),), (json.dumps(short | {"zz": 1}),), (json.dumps(short | {"m": "yes"}),)], "raw string")
    text, error = responses.decode_wire(F.col("raw"), 2)
    got = df.select(text.alias("t"), error.alias("e")).collect()
    assert json.loads(got[0]["t"]) == S2 and json.loads(got[1]["t"]) == S2 and got[0]["e"] is None
    assert got[2]["e"] == "compact response with missing, mixed or unknown keys" and got[3]["e"] == "a flag is no boolean"
    one = {responses.WIRE1[k]: v for k, v in S1.items()} | {"c": [{responses.WIRE_CANDIDATE[k]: v for k, v in c.items()} for c in S1["candidates"]]}
    text, error = responses.decode_wire(F.col("raw"), 1)
    assert json.loads(spark.createDataFrame([(json.dumps(one),)], "raw string").select(text.alias("t")).first()["t"]) == S1


def test_schema_errors(spark):
    kinds = {"a": dict(type="string", enum=["x"]), "b": dict(type="boolean"), "c": dict(type="array", items=dict(enum=["p"]))}
    schema = dict(type="object", required=["a", "b"], additionalProperties=False, properties=kinds)
    check = lambda raw: spark.createDataFrame([(raw,)], "r string").select(responses.schema_errors(F.col("r"), schema).alias("e")).first()["e"]
    assert check('{"a":"x","b":true,"c":["p"]}') == []
    assert check('{"a":"y","d":1,"c":["q"]}') == ["$.b: missing", "$: unknown keys", "$.a: not allowed", "$.c: item not allowed"]


def test_catalog(spark):
    df = spark.createDataFrame([("Proxy  contract", "c", "s", "d" * 300, "a; b;"), ("Vote", "c", "", "short", "")], "pattern string, category string, subcategory string, description string, keywords string")
    loaded = catalog.load_catalog(df)
    line = loaded.where("pattern = 'Proxy contract'").first()["compact_line"]
    assert line == "- Proxy contract [c / s]: " + "d" * 257 + "..."
    resource = spark.createDataFrame([("Vote", "P001", "curated", __import__("hashlib").sha256(b"short").hexdigest()), ("Proxy contract", "P002", "stale", "0")], "pattern string, pattern_id string, short_definition string, source_description_sha256 string")
    c = {r["pattern"]: r for r in catalog.compact(loaded, resource, [["Vote", "Poll"]], {"Vote": ["ballot"]}).collect()}
    assert c["Vote"]["short_definition"] == "curated" and c["Vote"]["family"] == "F00" and c["Proxy contract"]["short_definition"] == "d" * 300 and c["Proxy contract"]["keywords"] == ["a", "b"]
    with pytest.raises(audit.Violation):
        catalog.load_catalog(df.unionByName(df.limit(1).withColumn("pattern", F.lit("proxy-contract"))))


def brute_shortlist(scores, lexical, names, families, c):
    ranked = sorted(range(len(names)), key=lambda i: (-scores[i], i))
    chosen = set(lexical) | set(ranked[: c.minimum]) | {i for i in ranked[: c.maximum] if scores[i] >= c.threshold}
    top = scores[ranked[0]]
    flags = [f for f, b in (("low_confidence", top < c.confidence), ("ambiguous_similarity", sum(s >= max(c.threshold / 2, top * c.ambiguity) for s in scores) > c.maximum), ("no_lexical_anchor", c.require_anchor and not lexical)) if b]
    if not c.enabled or c.force_all:
        flags, chosen = ["forced_full_catalog" if c.enabled else "disabled"], set(range(len(names)))
    elif flags:
        chosen |= set(range(len(names))) if c.fall_back_to_all else set(ranked[: c.fallback_multiplier * c.maximum])
    pre = set(chosen)
    for g in families if c.family_expansion else []:
        if pre & {names.index(n) for n in g}:
            chosen |= {names.index(n) for n in g}
    return [names[i] for i in sorted(chosen)], flags, len(chosen - pre)


def test_shortlist(spark):
    import random

    rng, names = random.Random(4), [f"n{i:02}" for i in range(30)]
    families = [["n00", "n10", "n20"], ["n05", "n06"]]
    data = [(k, [round(rng.random() ** rng.choice([1, 4]), 3) for _ in names], rng.sample(range(30), rng.choice([0, 0, 1, 3]))) for k in range(60)]
    df = spark.createDataFrame(data, "k int, s array<double>, l array<int>")
    for c in (retrieval.Config(), retrieval.Config(fall_back_to_all=False), retrieval.Config(require_anchor=False, confidence=0.1, ambiguity=1.0, family_expansion=False), retrieval.Config(force_all=True), retrieval.Config(enabled=False)):
        for r in retrieval.shortlist(df, "s", "l", names, families, c).collect():
            want = brute_shortlist(r["s"], r["l"], names, families, c)
            assert (r["candidates"], r["fallback_reasons"], r["family_added"]) == want


def test_latent_scores(spark):
    entries = spark.createDataFrame([("a", "solar wind power"), ("b", "token vote ballot"), ("c", "vote power")], "name string, text string")
    model = retrieval.fit_latent(entries, "name", "text")
    docs = spark.createDataFrame([("vote ballot token",), ("unknown words",), ("",)], "text string")
    got = [r["scores"] for r in retrieval.latent_scores(docs, "text", model).collect()]
    assert max(range(3), key=lambda i: got[0][i]) == 1 and got[0][1] == pytest.approx(1, abs=1e-6)
    assert got[1] == [0, 0, 0] and got[2] == [0, 0, 0]


def test_lexical_matches_and_friends(spark):
    docs = spark.createDataFrame([(1, "We use an Oracle database and a load balancer"), (2, "vote now"), (3, None)], "id int, text string")
    words = spark.createDataFrame([("O", "oracle", True), ("V", "Vote", True), ("D", "database and", False)], "pattern string, phrase string, direct boolean")
    assert rows(retrieval.lexical_matches(docs, "id", "text", words).select("id", "pattern")) == [(1, "D"), (1, "O"), (2, "V")]
    rules = spark.createDataFrame([("O", r"(?i)\boracle\s+(?:db|database)\b", "product"), ("V", "vote", "x")], "pattern string, regex string, reason string")
    cand = spark.createDataFrame([(1, "O"), (1, "V"), (2, "O")], "id int, pattern string")
    assert rows(retrieval.false_friends(docs, "id", "text", cand, rules)) == [(1, "O", "product")]
    text = spark.createDataFrame([(1, "some words here stand"), (2, "ords her")], "id int, text string")
    passages = spark.createDataFrame([(1, "me words he"), (2, "ords"), (3, "words x here")], "p int, t string")
    assert rows(retrieval.literal_passages(text, "id", "text", passages, "p", "t")) == [(1, 1), (1, 2), (2, 2)]


def test_context(spark):
    body = "".join(f"sentence number {i} about things\n" for i in range(100)) + "rare evidence\n"
    df = spark.createDataFrame([(body, "talk " * 200, "things", ["rare evidence"]), ("short", "", "q", []), (None, None, None, None)], "b string, c string, q string, r array<string>")
    got = [r["context"] for r in spans.select_context(df, "b", "c", "q", 600, required="r").collect()]
    assert "rare evidence" in got[0]["body"] and len(got[0]["body"]) + len(got[0]["comments"]) <= 600 and got[0]["omitted"]
    assert got[1]["body"] == "short" and not got[1]["omitted"] and got[2]["body"] == ""
    tight = spans.select_context(df.limit(1).withColumn("r", F.array(F.lit("x" * 3 + body[:700]), F.lit(body[:700]))), "b", "c", "q", 90, required="r").first()["context"]
    assert tight["error"] is not None and tight["body"] is None


def test_sources_and_sinks(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_bytes("﻿Repository;Issue Number;issue_title;issue_body\na;15.0;t;\"line\none; \"\"q\"\"\"\n".encode())
    assert files.probe(spark, str(p)) == ("utf-8-sig", ";")
    row = files.load_input(spark, str(p)).first()
    assert (row["issue_number"], row["issue_body"]) == ("15", 'line\none; "q"')
    q = tmp_path / "old.csv"
    q.write_bytes("name,x\ncafé – €,\n".encode("cp1252"))
    assert files.read_csv(spark, str(q)).first().asDict() == {"name": "café – €", "x": ""}
    out = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    sinks.write_table(df, out)
    sinks.write_table(df.union(df), out)
    assert spark.read.parquet(out).count() == 2
    with pytest.raises(audit.Violation):
        sinks.write_table(df, out, replace=False)
    sinks.write_once(df, out + "1")
    sinks.write_once(df, out + "1")
    with pytest.raises(audit.Violation):
        sinks.write_once(df.union(df), out + "1")
    sinks.write_document(spark, out + "2", {"b": 1, "a": [2]})
    assert sinks.read_document(spark, out + "2") == {"a": [2], "b": 1}
    sinks.ensure_table(spark, out + "3", "a int")
    assert spark.read.parquet(out + "3").count() == 0
    results = tmp_path / "s2.csv"
    results.write_text("repository,issue_number,pattern,verdict\nr,1,A,yes\nr,1,A,no\n")
    with pytest.raises(audit.Violation):
        files.read_results(spark, str(results), 2)


def test_human_gold(spark):
    issues = spark.createDataFrame([("r", "1.0", "llm: Vote; A1: Oracle|vote", ""), ("r", "2", "", "ORACLE")], "repository string, issue_number string, patterns_confirmed string, patterns_uncertain string")
    strict, unsure = files.human_gold(issues, ["Oracle", "Vote"])
    assert rows(strict) == [("r", "1", "Oracle"), ("r", "1", "Vote")] and rows(unsure) == [("r", "2", "Oracle")]
    pairs = spark.createDataFrame([("r", "1", "vote", "yes"), ("r", "1", "oracle", "uncertain")], "repository string, issue_number string, pattern string, human_verdict string")
    assert [d.count() for d in files.human_gold(issues, ["Oracle", "Vote"], pairs)] == [1, 1]


def test_streams(spark, tmp_path):
    folder = tmp_path / "ledger"
    folder.mkdir()
    line = lambda i, t: json.dumps({"stage": "stage1", "repository": "r", "issue_number": str(i), "pattern": "P", "batch_name": "b", "timestamp": t})
    (folder / "a.json").write_text("\n".join([line(1, "2024-01-01T00:10:00Z"), line(1, "2024-01-01T00:10:00Z"), line(2, "2024-01-01T01:00:00Z")]))
    calls = stream.stream_ledger(spark, str(folder))
    once = stream.run_once(stream.without_replays(calls), "append")
    assert once.count() == 2
    out = str(tmp_path / "results")
    rows_ = calls.select("repository", "issue_number", F.lit(1).alias("v"))
    for _ in range(2):
        stream.upsert_stream(rows_, out, ["repository", "issue_number"], str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_streamed_results_are_the_latest(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "repository string, issue_number string, at long, v string"
    put = lambda rows_: spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").json(source)
    go = lambda: stream.upsert_stream(spark.readStream.schema(schema).json(source), out, ["repository", "issue_number"], str(tmp_path / "state"), order="at", parts=4).awaitTermination()
    put([("r", "1", 1, "old"), ("r", "1", 3, "new"), ("r", "2", 1, "x")])
    go()
    put([("r", "1", 2, "late"), ("r", "3", 1, "y")])
    go()
    assert sorted((r["issue_number"], r["v"]) for r in spark.read.parquet(out).collect()) == [("1", "new"), ("2", "x"), ("3", "y")]


def catalog_of_three(spark):
    return spark.createDataFrame([
        ("Guard", "X1", "a guard checks callers before entry of a function", "Security", "Access", "a guard checks callers before entry of a function"),
        ("Oracle", "X2", "an oracle reports outside data such as prices", "Data", "Feeds", "an oracle reports outside data such as prices"),
        ("Proxy", "X3", "a proxy forwards calls so that code can be upgraded", "Structure", "", "a proxy forwards calls so that code can be upgraded"),
    ], "pattern string, pattern_id string, short_definition string, category string, subcategory string, description string")


def test_requests_and_contexts(spark):
    frame = catalog_of_three(spark)
    entries = requests.Entries.of(frame)
    rules = frame.select("pattern", F.col("pattern").alias("phrase"), F.lit(True).alias("direct"))
    model = retrieval.fit_latent(frame, "pattern", "short_definition")
    filler = "\n".join(f"line {i} says little of any use to a reader" for i in range(200))
    told = "The oracle reports prices late."
    issues = spark.createDataFrame([("r", "1", "Prices", filler + "\n" + told + "\n" + filler, "no comment", "issue"), ("r", "2", "Nothing", "", "", "issue")], "repository string, issue_number string, issue_title string, issue_body string, concatenated_comments string, type string")
    out = {r["issue_number"]: r for r in requests.prepare_optimized(issues, entries, rules, [["Guard", "Proxy"]], model, retrieval.Config(fall_back_to_all=False, minimum=1, maximum=1), tokens=500).collect()}
    assert "Oracle" in out["1"]["candidates"] and told in out["1"]["artifact_text"] and len(out["1"]["artifact_text"]) <= 2000 and out["1"]["input_truncated"] and out["1"]["context_error"] is None
    assert not out["2"]["input_truncated"] and "context_omitted" not in out["2"]["artifact_text"]
    tight = requests.prepare_optimized(issues, entries, rules, [], model, tokens=60).collect()
    assert all(r["context_error"] and r["artifact_text"] is None for r in tight)
    prepared = requests.prepare_optimized(issues, entries, rules, [], model, tokens=500)
    first = requests.stage1_requests(prepared.where("issue_number = '1'"), entries, "Be strict.", {"type": "object"}).first()
    assert first["prompt"].startswith('Be strict.\n{"type":"object"}\nCATALOG:\nX1 Guard: a guard') and first["prompt"].endswith(first["artifact_text"])
    stage1 = spark.createDataFrame([("r", "1", "succeeded", json.dumps([{"pattern": "Proxy", "evidence_text": "line 7 says little of any use"}]))], "repository string, issue_number string, request_status string, candidate_details string")
    assert rows(requests.evidence_of(stage1)) == [("r", "1", "Proxy", "line 7 says little of any use")]
    pairs = spark.createDataFrame([("r", "1", "Proxy")], "repository string, issue_number string, pattern string")
    context = requests.stage2_contexts(pairs, prepared, stage1, entries, 300)
    assert "line 7 says little of any use" in context.first()["artifact_text"]
    second = requests.stage2_requests(context, frame, entries, "Decide.", {}).first()
    assert "CANDIDATE: Proxy\nStructure" in second["contents"] and second["prompt"].startswith("Decide.\n{}\n")
    with pytest.raises(ValueError, match="other entries"):
        requests.prepare_optimized(issues, requests.Entries(("A",), ("X",), ("d",)), rules, [], model)


def test_optimized_run(spark):
    frame = catalog_of_three(spark)
    profile = composites.Optimized(requests.Entries.of(frame), frame.select("pattern", F.col("pattern").alias("phrase"), F.lit(True).alias("direct")), retrieval.fit_latent(frame, "pattern", "short_definition"))
    issues = spark.createDataFrame([("r", "1", "t1", "the body speaks of an oracle that reports", "", "pull_request"), ("r", "2", "t2", "nothing", "", "issue")], "repository string, issue_number string, issue_title string, issue_body string, concatenated_comments string, type string")
    seen: list = []

    def first(asked):
        seen.append({r["issue_number"]: r["candidates"] for r in asked.select("issue_number", "candidates").collect()})
        return asked.select("custom_id", F.lit(0).alias("pos"), F.lit(json.dumps(S1)).alias("response"))

    def second(asked):
        seen.append([r["artifact_text"] for r in asked.collect()])
        return asked.select("custom_id", F.lit(0).alias("pos"), F.lit(json.dumps(S2 | {"evidence_text": "oracle that reports"})).alias("response"))

    out = composites.run(issues.where("issue_number = '1'"), PATTERNS, first, second, optimized=profile)
    assert "Oracle" in seen[0]["1"] and all(t.startswith("<artifact_type>pull_request") for t in seen[1])
    assert out["issues"].first()["relevant_to_pattern_study"] == "yes"


def test_wire_and_outcomes(spark):
    ids = {"Guard": "X1", "Oracle": "X2"}
    value = spark.createDataFrame([(json.dumps({"issue_summary": "s", "issue_activity_type": "other", "issue_challenge_categories": [], "context_status": "sufficient", "candidates": [{"pattern": p, "evidence_text": "e", "evidence_location": "body", "rationale": "r", "confidence": "high"}]}),) for p in ("Guard", "Oracle", "Other")], "j string").coalesce(1)
    from tallgrass.types import STAGE1_PAYLOAD

    wire = value.select(responses.encode_wire(F.from_json("j", STAGE1_PAYLOAD), 1, ids).alias("w"))
    assert '"p":"X1"' in wire.first()["w"] and set(json.loads(wire.first()["w"])) == set("sthxc")
    text, error = responses.decode_wire(F.col("w"), 1, ids, F.array(F.lit("Guard")))
    got = wire.select(text.alias("t"), error.alias("e")).collect()
    assert [r["e"] for r in got] == [None, "pattern outside the shortlist", "pattern unknown"] and json.loads(got[0]["t"])["candidates"][0]["pattern"] == "Guard"
    assert "p=pattern" in responses.wire_legend(1) and responses.wire_legend(2).startswith("Keys: v=verdict")
    short = responses.wire_schema({"properties": {"verdict": {"type": "string"}}, "required": ["verdict"]}, 2)
    assert short == {"properties": {"v": {"type": "string"}}, "required": ["v"]}
    answers = [None, "oops", '{"choices":[]}', '{"choices":[{"message":{"content":"x"},"finish_reason":"length"}]}', '{"choices":[{"message":{"content":" x "}}],"usage":{"prompt_tokens":3},"timings":{"prompt_per_second":2.5}}']
    told = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string").coalesce(1).select("i", responses.outcome(F.col("a")).alias("o")).orderBy("i").collect()
    assert [r["o"]["error"] for r in told] == ["no answer", "no answer", "no choices", "finish is not STOP", None]
    assert (told[4]["o"]["text"], told[4]["o"]["input_tokens"], told[4]["o"]["prompt_tokens_per_second"]) == ("x", 3, 2.5)


def test_sources_of_answers_run_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def ask(x):
        calls.add(1)
        return x

    asked = spark.createDataFrame([("a", 0), ("b", 1)], "custom_id string, pos int")
    out = stages.match_responses(asked, asked.select("custom_id", "pos", ask("custom_id").alias("response")))
    assert out.count() == 2 and out.where("response = custom_id").count() == 2 and calls.value == 2


def test_run_and_compare(spark):
    issues = spark.createDataFrame([("r", "1", "t1", "the body speaks of an oracle that reports", "", "pull_request"), ("r", "2", "t2", "nothing", "", "issue")], "repository string, issue_number string, issue_title string, issue_body string, concatenated_comments string, type string")
    asked: list[int] = []

    def first(requests):
        asked.append(requests.count())
        return requests.select("custom_id", F.lit(0).alias("pos"), F.when(F.col("issue_number") == "1", F.lit(json.dumps(S1))).otherwise(F.lit("broken")).alias("response"))

    def second(requests):
        asked.append(requests.count())
        return requests.select("custom_id", F.lit(0).alias("pos"), F.lit(json.dumps(S2 | {"evidence_text": "oracle that reports"})).alias("response"))

    out = composites.run(issues, PATTERNS, first, second)
    final = {r["issue_number"]: r for r in out["issues"].collect()}
    assert (final["1"]["relevant_to_pattern_study"], final["1"]["patterns_confirmed"], final["1"]["confidence"], final["1"]["evidence_location"]) == ("yes", "Oracle", "medium", "pull_request_description")
    assert final["2"]["relevant_to_pattern_study"] == "pipeline_error" and out["integrity"].first()["status"] == "OK" and out["stage2"].first()["evidence_is_literal"]
    again = composites.run(issues, PATTERNS, first, second, out["stage1"], out["stage2"])
    assert asked == [2, 1, 1, 0] and again["stage1"].count() == 2
    human = spark.createDataFrame([("r", "1", "yes"), ("r", "2", "no")], "repository string, issue_number string, human_relevance string")
    gold = spark.createDataFrame([("r", "1", "Oracle")], "repository string, issue_number string, pattern string")
    settings = spark.createDataFrame([("model", "m")], "name string, value string")
    side = composites.Run(out["stage1"], out["stage2"], out["issues"], settings)
    report = composites.compare_runs(human, gold, side, side, ["model"])
    assert rows(report["gates"]) == [("no_new_misses", "true"), ("recall", "true"), ("tokens_saved", "NOT_MEASURED")] and report["approved"].first()["approved"] is False
    pairs = composites.evaluate_pairs(gold.withColumn("human_verdict", F.lit("yes")), out["stage1"], out["stage2"])
    assert pairs["stage1"].first()["recall"] == 1 and pairs["binary"].first()["tp"] == 1
    assert composites.evaluate_issues(human, out["issues"])["binary"].first()["n"] == 1
    assert composites.quality_checks(out["stage2"]).where("not passed").count() == 0


def test_progress_and_status(spark):
    s1 = spark.createDataFrame([("r", "1", "c1", "succeeded", '["A","B"]'), ("r", "2", "c2", "errored", "[]"), ("r", "2", "c2", "succeeded", "[]")], "repository string, issue_number string, custom_id string, request_status string, candidates string")
    assert rows(stages.progress(s1)) == [("c1", "completed"), ("c2", "completed")]
    s2 = spark.createDataFrame([("r", "1", "A", "succeeded", "yes")], "repository string, issue_number string, pattern string, request_status string, verdict string")
    final = spark.createDataFrame([("r", "1", "yes")], "repository string, issue_number string, relevant_to_pattern_study string")
    got = {(r["part"], r["value"]): r["rows"] for r in stages.run_status(s1, s2, final, 5).collect()}
    assert got[("pending", "pairs")] == 1 and got[("pending", "issues")] == 3 and got[("verdict", "yes")] == 1 and got[("stage1", "errored")] == 1
    assert {(r["part"], r["value"]): r["rows"] for r in stages.run_status(s1, s2, final).collect()}[("pending", "issues")] is None


def test_resume_guard_and_limits(spark):
    old = spark.createDataFrame([("provider", "local"), ("model", "m"), ("seed", "1")], "name string, value string")
    new = spark.createDataFrame([("provider", "local_server"), ("model", "m2"), ("fresh", "x")], "name string, value string")
    assert sorted(r["name"] for r in audit.resume_conflicts(old, new, {"local": "local_server"}).collect()) == ["model", "seed"]
    df = spark.createDataFrame([(3,), (1,), (2,)], "o int")
    assert [r["o"] for r in prepare.first_rows(df, 2, "o").collect()] == [1, 2]
    with pytest.raises(ValueError, match="above zero"):
        prepare.first_rows(df, 0, "o")


def test_manifest_and_digests(spark, tmp_path):
    p = tmp_path / "a.txt"
    p.write_bytes(b"abc")
    got = files.file_digests(spark, str(p)).first()
    assert (got["bytes"], got["sha256"]) == (3, __import__("hashlib").sha256(b"abc").hexdigest())
    folder, df = f"{tmp_path}/m", spark.createDataFrame([(1,)], "i int")
    for _ in range(2):
        sinks.save_manifest(spark, folder, {"run": {"model": "m", "n": 1}}, {"input": df})
    with pytest.raises(audit.Violation):
        sinks.save_manifest(spark, folder, {"run": {"model": "other"}}, {"input": df})


def test_fallback_report(spark):
    kind = "repository string, issue_number string, candidates array<string>, fallback_reasons array<string>, tokens long"
    actual = spark.createDataFrame([("r", "1", ["A", "B", "C"], ["low_confidence", "no_lexical_anchor"], 30), ("r", "2", ["A"], [], 5)], kind)
    without = spark.createDataFrame([("r", "1", ["A"], [], 10), ("r", "2", ["A"], [], 5)], kind)
    gold = spark.createDataFrame([("r", "1", "B"), ("r", "2", "A")], "repository string, issue_number string, pattern string")
    assert rows(composites.fallback_report(actual, without, gold)) == [("low_confidence", 1, 1, 2, 20), ("no_lexical_anchor", 1, 1, 2, 20)]
    scored = spark.createDataFrame([("r", "1", [0.9, 0.1, 0.0], [0], 10), ("r", "2", [0.0, 0.0, 0.2], [], 4)], "repository string, issue_number string, scores array<double>, lexical array<int>, tokens long")
    gold = spark.createDataFrame([("r", "1", "A"), ("r", "2", "A")], gold.schema)
    out = composites.retrieval_benchmark(scored, gold, ["A", "B", "C"], [["B", "C"]], {"all": retrieval.Config(1, 2), "few": retrieval.Config(1, 2, fall_back_to_all=False, require_anchor=False, confidence=0.0)})
    totals = {r["config"]: r for r in out["totals"].collect()}
    assert totals["all"]["misses"] == 0 and totals["few"]["misses"] == 1 and out["recommended"].first()["config"] == "all"
    assert out["leave_one_out"].count() == 2 and out["recall"].where("config = 'all' and pattern is null and family is null").first()["recall"] == 1
    prompts = spark.createDataFrame([("legacy", "stage1", "x" * 400), ("short", "stage1", "x" * 100)], "profile string, stage string, text string")
    assert {r["profile"]: r["reduction_percent"] for r in composites.token_benchmark(prompts).collect()} == {"legacy": 0.0, "short": 75.0}
