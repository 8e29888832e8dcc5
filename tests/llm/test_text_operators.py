"""Line dedup, near-duplicates, quality rules, personal data."""

from __future__ import annotations

import random

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallgrass.llm import common, linededup, pii, quality, simhash


def test_line_dedup(documents, document_rows, spark):
    for sites in (3, 8):
        want = sorted((repr(k), *r[:1], r[1], r[2]) for (k, *_), r in zip(document_rows, brute.deduped_lines([(k, t, s) for k, t, _, s, _ in document_rows], sites)) if r[0] is not None)
        got = linededup.dedup_lines(documents.withColumn("pos", F.lit(1)).withColumn("key", F.lit("k")), min_sites=sites)
        assert sorted((repr(r["doc_id"]), r["text"], r["n_lines"], r["n_removed"]) for r in got.collect() if r["text"] is not None) == want
        assert got.where("text is null").count() == 1 and got.columns[:5] == documents.columns


def test_line_dedup_edges(spark, no_documents):
    assert linededup.dedup_lines(no_documents).count() == 0
    rows = [(i, "same line\n" * 3 + f"own {i}", "x", f"s{i % 12}", 0) for i in range(60)] + [(None, "same line", "x", None, 0)]
    df = spark.createDataFrame(rows, no_documents.schema)
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(df).collect()}
    assert got[0] == "same line\nown 0" and got[1] == "own 1" and got[None] == ""
    near = linededup.boilerplate(df, short_sites=13)
    assert near.count() == 1  # twelve sources and null
    assert linededup.boilerplate(df, short_sites=14).count() == 0


def test_line_dedup_many_lines(spark, no_documents):
    rows = [(i, "\n".join(["all share this"] * 20_000 + [f"d{i}"]), "x", f"s{i}", 0) for i in range(11)]
    got = linededup.dedup_lines(spark.createDataFrame(rows, no_documents.schema)).select("n_lines", "n_removed").collect()
    assert sorted(tuple(r) for r in got) == [(20_001, 19_999)] + [(20_001, 20_000)] * 10


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abC \n\té", max_size=80))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute.fingerprint(text)


def test_components_of_fingerprints(spark):
    rng = random.Random(8)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(160):
        x = rng.choice(fps)
        for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 3, 4, 5])):
            x ^= 1 << b
        fps.append(x)
    fps += [0, 0, 7, (1 << 64) - 1]
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "doc_id long, fp long").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(df).collect()}
    assert [got[i] for i in range(len(fps))] == brute.components(fps)


def test_simhash_of_documents(documents, document_rows):
    keyed = sorted(document_rows, key=lambda r: (r[0] is None, r[0] or 0))
    fps = [brute.fingerprint(r[1]) for r in keyed]
    want = sorted((repr(r[0]), fps[i], keyed[c][0]) for (i, r), c in zip(enumerate(keyed), brute.components(fps)))
    got = simhash.simhash_components(documents)
    assert sorted((repr(r["doc_id"]), r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got.collect()) == want


def test_near_duplicates_keep_one(documents, document_rows, no_documents):
    left = simhash.drop_near_duplicates(documents)
    keyed = [(r[0], r[1]) for r in document_rows if r[0] is not None]
    assert left.columns == documents.columns and sorted(r["doc_id"] for r in left.collect()) == brute.without_similar(keyed)
    assert simhash.drop_near_duplicates(no_documents).count() == 0
    assert simhash.simhash_components(no_documents).count() == 0


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 150)] + [(200, 200), (7, 3)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["root"] for r in common.components(df).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 150)}
    assert common.components(df.limit(0)).count() == 0


def test_global_rank(spark):
    df = spark.range(500).select((F.col("id") % 7).alias("k"), "id").repartition(6)
    got = sorted((r["rank"], r["k"], r["id"]) for r in common.global_rank(df, ["k", "id"]).collect())
    assert [g[0] for g in got] == list(range(500)) and [g[1:] for g in got] == sorted(g[1:] for g in got)


def test_quality(documents, document_rows):
    out = quality.with_verdicts(documents.withColumn("kept", F.lit("clash")).withColumn("n", F.lit(0)))
    want = brute.kept([(t, s) for _, t, _, s, _ in document_rows])
    expect = sorted((repr(r[0]), *brute.measures(r[1]).values(), k) for r, k in zip(document_rows, want))
    assert sorted((repr(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["kept"]) for r in out.collect()) == expect
    assert quality.keep_quality(documents).columns == documents.columns


def test_failed_host_loses_only_its_faulty(spark, no_documents):
    good, bad = " ".join(f"word{i}" for i in range(80)), " ".join(f"w{i} ##" for i in range(80))
    rows = [(i, bad, "x", "dirty", 0) for i in range(30)] + [(100, good, "x", "dirty", 0)] + [(200 + i, good + f" {i}", "x", f"h{i % 5}", 0) for i in range(60)] + [(300, bad, "x", "h1", 0)]
    got = {r["doc_id"]: r["kept"] for r in quality.with_verdicts(spark.createDataFrame(rows, no_documents.schema)).collect()}
    assert not got[0] and got[100] and got[200] and not got[300]  # a clear failure goes on any host
    assert [got[r[0]] for r in rows] == brute.kept([(r[1], r[3]) for r in rows])
    assert quality.with_verdicts(no_documents).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=120), min_size=1, max_size=30))
def test_measures(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    got = [tuple(r)[1:] for r in quality.with_measures(df).collect()]
    assert got == [tuple(brute.measures(t).values()) for t in texts]


TRICKY = [
    "a@b.c._x@y.z", "x@y", "..a@b-c.d.e@f.g", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.0255 0000.0.0.0", "4111 1111 1111 1111-4111-1111-1111-1111", "4111111111111111 5", "+1 (403) 555-9312 +12 +1234567890123456", "+1.2-3 4(5)6 789", "12 34 56 78 90 12",
    "é😀 bob@x.io é 10.0.0.1", "5500005555555559x4111111111111111", "1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", None, "", "+" * 50, "1" * 500, "a" * 3000 + "@" + "b" * 3000 + ".c", "1-" * 4000, "+1" + " " * 3000 + "2", "a@a.a " * 400,
]


def as_joined(spans):
    return brute.joined([(s["start"], s["end"], pii.ALL_KINDS[s["kind"]]) for s in spans])


def test_base_spans(spark):
    rng = random.Random(2)
    texts = TRICKY + ["".join(rng.choice("ab1234567890. @+-()é") for _ in range(rng.randint(0, 120))) for _ in range(600)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id int, text string, base string").repartition(4)
    for r in pii.with_base_spans(df).collect():
        assert as_joined(r["base"]) == brute.joined(brute.base_spans(texts[r["id"]])), texts[r["id"]]


def test_boosted_candidates(spark):
    model = pii.fit(spark)
    texts = ["please call (212) 555-0182 today", "tel: 0301234567 abends", "bob [at] mail [dot] org ok", "version 12.345.6789 is out", "order 123456789012 shipped", "plain words at home. nothing", "fe80:0:0:0:202:b3ff:fe1e:8329 is up", "call +1 (403) 555-9312 now"]
    got = [r["spans"] for r in pii.with_spans(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), model=model).collect()]
    found = [[(pii.ALL_KINDS[s["kind"]], t[s["start"] : s["end"]]) for s in spans] for t, spans in zip(texts, got)]
    assert found[0] == [("phone", "(212) 555-0182")] and found[1] == [("phone", "0301234567")] and found[2] == [("email", "bob [at] mail [dot] org")]
    assert found[3] == found[4] == found[5] == [] and found[6] == [("ip", "fe80:0:0:0:202:b3ff:fe1e:8329")] and found[7] == [("phone", "+1 (403) 555-9312")]


def test_boosting_on_held_out_sentences(spark):
    model = pii.fit(spark)
    sample = pii.labelled_texts(600, seed=99)
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(sample)], "id int, text string")
    spans = {r["id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in pii.with_spans(df, model=model).collect()}
    hit = sum(any(abs(x - a) <= 1 and abs(y - b) <= 1 for x, y in spans[i]) for i, (_, a, b, _) in enumerate(sample) if a >= 0)
    false = sum(bool(spans[i]) for i, (_, a, *_) in enumerate(sample) if a < 0)
    assert hit >= 0.8 * 300 and false <= 0.05 * 300


def test_trees_in_sql_are_the_trees(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.integers(0, 5, (200, len(pii.FEATURES))).astype(float)
    y = (x[:, 1] + x[:, 3] > 4).astype(float)
    model = pii.boost(x, y, 10, 0.3)
    trees = pii.Trees(*model, 1.0, 0.0, (0.5,) * 5)
    f = F.struct(*[F.col(n) for n in pii.FEATURES])
    df = spark.createDataFrame(x.tolist(), list(pii.FEATURES)).coalesce(1)
    got = [r["p"] for r in df.select(f.alias("f")).select(F.expr(pii.probability(trees, "f")).alias("p")).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-pii.margins(model, x)))) and ((np.array(got) > 0.5) == (y > 0.5)).mean() > 0.9


def test_redaction(spark, documents, no_documents):
    texts = [t for t in TRICKY if t is None or len(t) < 200] + ["x bob@x.io\n+1 (403) 555-9312"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    spans = {r["id"]: [(s["start"], s["end"], pii.ALL_KINDS[s["kind"]]) for s in r["spans"]] for r in pii.with_spans(df).collect()}
    for r in pii.redact(df).collect():
        assert r["text"] == brute.redacted(texts[r["id"]], spans[r["id"]])
    assert pii.redact(no_documents).count() == 0 and pii.redact(documents).columns == documents.columns
