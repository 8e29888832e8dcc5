from __future__ import annotations

import math
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallgrass.functions import rules, text
from tallgrass.operators import spans


def one(spark, column_of, *values, kind="string"):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} {k}" for n, k in zip(names, [kind] * len(values) if isinstance(kind, str) else kind)))
    return df.select(column_of(*map(F.col, names)).alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "want"), [
    (None, ""), ("  a b ", "a b"), ("ﬁx​ me", "fix me"), ("a\r\nb\tc", "a b c"), ("a–b", "a-b"), ("x\x07y", "xy"), ("a‍b", "a‍b"), ("a b", "a b"),
])
def test_clean_token(spark, given, want):
    assert one(spark, text.clean_token, given) == want


def test_clean_text_keeps_lines(spark):
    assert one(spark, text.clean_text, " a\r\nb\u2028c\t d \n") == "a\nb\nc\t d"


@pytest.mark.parametrize(("a", "b", "same"), [("Check-Effects", "check effects", True), ("A_B", "a-b", True), ("Oracle", "Oracles", False), ("STRASSE", "Straße", True)])
def test_fingerprint(spark, a, b, same):
    assert (one(spark, text.fingerprint, a) == one(spark, text.fingerprint, b)) is same


@pytest.mark.parametrize(("given", "want"), [("15.0", "15"), ("15.00", "15"), ("v1.0", "v1.0"), ("1.5", "1.5")])
def test_issue_number(spark, given, want):
    assert one(spark, text.issue_number, given) == want


def test_label_number_cuts_any(spark):
    assert one(spark, text.label_number, "v1.0") == "v1"


@pytest.mark.parametrize(("given", "want"), [("a| b |a||", ["a", "b"]), ('["x","y","x"]', ["x", "y"]), ("[bad|c", ["[bad", "c"]), ("", [])])
def test_split_multivalue(spark, given, want):
    assert one(spark, text.split_multivalue, given) == want


def brute_head_tail(s, budget):
    s = s.strip()
    if len(s) <= budget:
        return s, False
    if budget <= 80:
        return s[:budget], True
    note = f"\n[... {len(s) - budget} caracteres omitidos ...]\n"
    room = max(1, budget - len(note))
    head = math.ceil(room * 0.65)
    return s[:head].rstrip() + note + s[-(room - head) :].lstrip(), True


def test_head_tail(spark):
    cases = [("x" * 50, 100), ("y" * 200, 60), ("ab " * 100, 100), ("é" * 1000, 500), ("  pad  ", 7), ("z" * 101, 100), ("word " * 3000, 1234)]
    df = spark.createDataFrame(cases, "t string, b int")
    cut, was = text.head_tail(F.col("t"), F.col("b"))
    got = [(r[0], r[1]) for r in df.select(cut, was).collect()]
    assert got == [brute_head_tail(t, b) for t, b in cases]


@pytest.mark.parametrize(("given", "want"), [("llm: yes; A1: no", "no"), ("A1: a; b: c", "a"), ("plain", "plain"), ("a1: many\nlines; x: 1", "many\nlines")])
def test_part_of(spark, given, want):
    assert one(spark, lambda c: text.part_of(c, "A1"), given) == want


def test_terms(spark):
    assert one(spark, text.terms, "getUserName of the Größe, ação a x1") == ["get", "user", "name", "große".replace("ß", "ss"), "acao", "x1"]


@pytest.mark.parametrize(("phrase", "where", "want"), [("vote", "Votes", False), ("Vote", "a vote.", True), ("a.b", "axb", False), ("a.b", "(A.B)", True), ("  ", "x", False), ("é", "né", False), ("x\\Ey", "x\\Ey", True)])
def test_phrase(spark, phrase, where, want):
    assert one(spark, text.phrase_in, phrase, where) is want


@pytest.mark.parametrize(("evidence", "where", "want"), [("a b", "xa by", True), ("a  b", "a\nb", True), ("", "x", False), ("x", "", False), (None, "x", False)])
def test_literal(spark, evidence, where, want):
    assert one(spark, text.literal_match, evidence, where) is want


@pytest.mark.parametrize(("given", "want"), [("https://h/v1/", "https://h"), ("http://u:p@h", None), ("ftp://h", None), (" https://h/a// ", "https://h/a")])
def test_base_url(spark, given, want):
    assert one(spark, text.base_url, given) == want


@pytest.mark.parametrize(("error", "again", "everywhere"), [("HTTP 429", True, False), ("rate limit", True, True), ("403 Forbidden timeout", False, True), ("odd", False, False), (None, False, False)])
def test_errors(spark, error, again, everywhere):
    assert one(spark, rules.retryable, error) is again
    assert one(spark, rules.global_error, error) is everywhere


@pytest.mark.parametrize(("row", "want"), [
    (("insufficient_context", "x" * 99, "no", "", True, True, True), "low"), (("no", "x" * 15, "yes", "", True, True, True), "medium"), (("no", "", "no", "", True, True, True), "low"),
    (("uncertain", "x" * 20, "yes", "", True, True, True), "low"), (("uncertain", "x" * 20, None, "", True, True, True), "medium"), (("yes", "x" * 60, "yes", "", True, True, True), "low"),
    (("yes", "x" * 60, "no", "", True, None, False), "medium"), (("yes", "x" * 60, "no", "not_related", True, True, True), "low"), (("yes", "x" * 60, "no", "", None, None, None), "high"), (("yes", "x" * 30, "no", "", True, True, True), "medium"),
])
def test_confidence(spark, row, want):
    assert one(spark, rules.stage2_confidence, *row, kind=["string"] * 4 + ["boolean"] * 3) == want


def test_remap(spark):
    df = spark.createDataFrame([(["body", "title"], "pull_request"), (["body"], "Pull Request")], "l array<string>, t string")
    assert [r[0] for r in df.select(rules.remap_locations(F.col("l"), F.col("t"))).collect()] == [["pull_request_description", "title"], ["body"]]
    assert [r[0] for r in df.select(rules.remap_locations(F.col("l"), F.col("t"), loose=True)).collect()][1] == ["pull_request_description"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=300), st.integers(2, 50), st.booleans())
def test_spans_are_the_text(t, most, lines_first):
    cut = spans.cut_spans(t, most, lines_first)
    assert "".join(t[a:b] for a, b in cut) == t
    assert all(b - a <= most for a, b in cut)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abc de\n", min_size=1, max_size=900), st.integers(90, 400))
def test_chosen_spans_fit(t, budget):
    chosen = spans.choose_spans(t, budget, "abc de", 100, edges=True)
    out = spans.OMITTED.join(t[a:b] for a, b in chosen)
    assert len(out) <= max(budget, 0)
    assert chosen == sorted(chosen)


def test_required_evidence_stays_or_is_an_error():
    t = "".join(f"line {i} of this text\n" for i in range(200)) + "the evidence here\n"
    chosen = spans.choose_spans(t, 300, "line", 100, required=["the evidence here"])
    assert any("the evidence here" in t[a:b] for a, b in chosen)
    with pytest.raises(spans.Overflow):
        spans.choose_spans("x" * 1000, 90, "", 600, required=["x" * 500])


def test_word_set_is_terms(spark):
    t = "Ünïcode camelCase x1 the naïve ação"
    assert spans.word_set(t) == set(one(spark, text.terms, t))
    assert unicodedata.normalize("NFKC", "ﬁ") == "fi"
