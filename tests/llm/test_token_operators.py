"""SentencePiece transducer, packing, language model, the pipeline, and all queries against their SQL."""

from __future__ import annotations

import itertools
import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from support import SF
from tokenizers import Tokenizer

import corpus_pipeline
from tallgrass.llm import entries, hmm, packing, pii, wfst

machine = wfst.Transducer.load(wfst.default_model())
library = sentencepiece.SentencePieceProcessor(model_file=wfst.default_model())
ODD = ["", " ", "  ", "a  b   c    ", " " * 50 + "x", "\n\n a\n b", "▁▁a ▁b", "日本語 テスト\x00x 😀", "...!!! a.b,c", "x" * 400, "١٢3 12345", "“quotes” — dash", "\ttab\r\n", ". .. ..."]


def encoded(texts):
    out = []
    for _, ids, edges in machine.encode_many(pa.array(texts, pa.string())):
        decoded = machine.decode_many(ids, edges)
        out += [(ids[a:b].tolist(), d.decode("utf-8", "replace")) for a, b, d in zip(edges[:-1], edges[1:], decoded)]
    return out


def test_transducer_equals_library(document_rows):
    texts = ODD + [r[1] for r in document_rows if r[1] is not None]
    assert [x[0] for x in encoded(texts)] == [library.encode(t) for t in texts]
    assert [x[1] for x in encoded(texts)] == [library.decode(library.encode(t)) for t in texts]


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_transducer_equals_library_on_any_text(text):
    if any("\ud800" <= c <= "\udfff" for c in text):
        return
    assert encoded([text])[0][0] == library.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="etaoinshr .,▁é", max_size=40))
def test_path_is_what_merging_leaves(text):
    word = wfst.SPACE + text.replace(" ", "").replace(wfst.SPACE, "")
    merged = machine.merged(word)[0]
    assert machine.path(word) == [i for p in merged for i in ([machine.id[p]] if p in machine.id else [machine.byte[b] for b in p.encode()])]


def test_pieces_in_tables(spark):
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate([*ODD, None])], "id int, text string, decoded string")
    both = wfst.decode_pieces(wfst.encode_pieces(df)).collect()
    for r in both:
        assert r["ids"] == (None if r["text"] is None else library.encode(r["text"]))
        assert r["decoded"] == (None if r["text"] is None else library.decode(library.encode(r["text"])))
    digests = {r["id"]: r for r in wfst.piece_digests(df.withColumn("n_ids", F.lit(1))).collect()}
    assert digests[0]["n_ids"] == 0 and digests[len(ODD)]["round_trip"] and not digests[6]["round_trip"] and digests[7]["n_bytes"] > 0
    assert wfst.piece_digests(df.limit(0)).count() == 0


tokenizer = Tokenizer.from_file(packing.default_tokenizer())
ODD_WORDS = ["it'S I'Ve <|endoftext|>x", "Å å H̱ İ ΣΑΣ ß ﬁ", "a.b,c !!! ... \x1c x\x1dy", "١٢ 12ab 日本語。", "", " 　 x y\x85z", "x́ ́y", "K Å Ⅷ ª", None]


def test_encoder_equals_tokenizer(document_rows):
    texts = ODD_WORDS + [r[1] for r in document_rows]
    got = []
    for _, ids, edges in packing.WordEncoder.load(packing.default_tokenizer()).encode_many(pa.array(texts, pa.string()), 2):
        got += [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:])]
    assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=40), st.integers(60, 120))
def test_windows_are_near_equal_and_within_capacity(lengths, capacity):
    lengths = np.array(lengths)
    window = packing.balanced(lengths, capacity)
    sums = np.bincount(window, weights=lengths)
    assert sums.max() <= capacity and len(window) == len(lengths)
    best, most = packing.differencing(lengths, 3)
    assert most == np.bincount(best, weights=lengths, minlength=3).max()


def test_differencing_beats_dealing_in_turn():
    rng = random.Random(6)
    lengths = np.array([rng.randint(1, 4000) for _ in range(500)])
    _, most = packing.differencing(lengths, 40)
    assert most <= 1.01 * lengths.sum() / 40


def check_packing(pieces, texts, capacity=4096):
    """pieces: rows with doc_id; texts: by doc_id."""
    by_doc, by_window = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_window.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for d, rows in by_doc.items():
        ids = tokenizer.encode(texts[d] or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for rows in by_window.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return sum(r["length"] for r in pieces) / (capacity * len(by_window))


def test_packing(spark, document_rows):
    texts = {i: r[1] for i, r in enumerate(document_rows)} | {1000 + i: t for i, t in enumerate(ODD_WORDS)}
    df = spark.createDataFrame([(i, t, "c") for i, t in texts.items()], "doc_id long, text string, start string").repartition(3)
    pieces = packing.pack(packing.cut_pieces(df, capacity=512), capacity=512, group=64).collect()
    assert check_packing(pieces, texts, 512) > 0.9
    assert packing.pack(packing.cut_pieces(df.limit(0))).count() == 0
    held = packing.cut_pieces(df, capacity=512, ids=True).where("doc_id = 1000").first()
    assert np.frombuffer(held["ids"], dtype="<u4").tolist() == tokenizer.encode(ODD_WORDS[0], add_special_tokens=False).ids + [2]


def test_forward_is_the_sum_over_paths():
    rng = np.random.default_rng(1)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    m = hmm.Model(norm(rng.random(3)), norm(rng.random((3, 3))), norm(rng.random((3, 5))))
    seqs = [np.array(x, dtype="<u2") for x in ([0, 4, 2, 2, 1], [3, 3, 0], [1])]
    logs = hmm.forward(m, seqs)
    for seq, log in zip(seqs, logs):
        total = sum(m.start[p[0]] * m.emit[p[0], seq[0]] * math.prod(m.move[a, b] * m.emit[b, s] for a, b, s in zip(p, p[1:], seq[1:])) for p in itertools.product(range(3), repeat=len(seq)))
        assert log == pytest.approx(math.log10(total), abs=1e-9)
    starts, moves, emits, _ = hmm.expectations(m, seqs)
    assert starts.sum() == pytest.approx(3) and moves.sum() == pytest.approx(6) and emits.sum() == pytest.approx(9)
    assert emits.sum(axis=0).tolist() == pytest.approx([2, 2, 2, 2, 1])


def test_blocks_change_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    m = hmm.Model(norm(rng.random(3)), norm(rng.random((3, 3))), norm(rng.random((3, 9))))
    seqs = [rng.integers(0, 9, n).astype("<i4") for n in (50, 33, 32, 31, 8, 1)]
    whole = hmm.forward(m, seqs), hmm.expectations(m, seqs)
    monkeypatch.setattr(hmm, "_BLOCK", 8)
    parts = hmm.forward(m, seqs), hmm.expectations(m, seqs)
    assert np.allclose(whole[0], parts[0])
    for x, y in zip(whole[1], parts[1]):
        assert np.allclose(x, y)
    assert whole[1][0].sum() == pytest.approx(6) and whole[1][2].sum() == pytest.approx(sum(map(len, seqs)))


def test_baum_welch_never_loses_likelihood(spark, documents):
    s = hmm.Settings(states=3, rounds=4, classes=32, least=20, frequent=1)
    corpus = hmm.prepare(documents.select("doc_id", "text"), "doc_id", "text", s)
    model, seen = hmm.initial(corpus, s), []
    for _ in range(4):
        model, log = hmm.baum_welch(corpus, model, floor=1e-9)
        seen.append(log)
    assert seen == sorted(seen) and seen[-1] > seen[0]
    totals = model.words.agg(*[F.sum(F.col("e")[k]).alias(f"s{k}") for k in range(3)]).first()
    assert [x + y for x, y in zip(totals, model.core.emit.sum(axis=1))] == pytest.approx([1, 1, 1])


def log_space_scores(rows, s, spark_model, spark_words):
    """Scores by a forward recursion in logarithms, word by word, from the trained tables and plain counts."""
    tokens = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + [" "]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % s.folds == s.held
    c = Counter(w for k, t in rows if not held(k) for w in tokens(t))
    cls = lambda w: zlib.crc32(w[-2:].encode()) % s.classes
    every = {w for _, t in rows for w in tokens(t)}
    rare = [w for w in every if c[w] < s.least]
    mass, kinds = Counter(), Counter()
    for w in rare:
        mass[cls(w)] += c[w]
        kinds[cls(w)] += c[w] > 0
    out = []
    for k, t in rows:
        alpha, total = None, 0.0
        for w in tokens(t):
            if w in spark_words:
                e, share = spark_words[w], 0.0
            else:
                e, share = spark_model.emit[:, cls(w)], math.log((c[w] + 0.5) / (mass[cls(w)] + 0.5 * (kinds[cls(w)] + 1)))
            step = np.log(spark_model.start) if alpha is None else np.logaddexp.reduce(alpha[:, None] + np.log(spark_model.move), axis=0)
            alpha, total = step + np.log(np.asarray(e)), total + share
        out.append((k, (np.logaddexp.reduce(alpha) + total) / math.log(10)))
    return out


def test_scores_by_an_independent_forward(spark, documents, document_rows):
    s = hmm.Settings(states=3, rounds=2, classes=16, least=15, frequent=1)
    corpus = hmm.prepare(documents.select("doc_id", "text"), "doc_id", "text", s)
    model = hmm.initial(corpus, s)
    for _ in range(2):
        model, _ = hmm.baum_welch(corpus, model)
    words = {r["word"]: r["e"] for r in model.words.collect()}
    assert len(words) > 20
    want = sorted((repr(k), round(x, 6)) for k, x in log_space_scores([(r[0], r[1]) for r in document_rows], s, model.core, words))
    got = sorted((repr(r["doc_id"]), round(r["score"], 6)) for r in hmm._scores(corpus, model, "doc_id").collect())
    assert [k for k, _ in got] == [k for k, _ in want] and [x for _, x in got] == pytest.approx([x for _, x in want], abs=1e-5)


def test_language_model(spark, documents, document_rows, no_documents):
    got = hmm.score_hmm(documents.withColumn("score", F.lit(1)), settings=hmm.Settings(rounds=6, least=20, frequent=1)).toPandas()
    tokens = lambda t: (t or "").encode().lower().split() + [b" "]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 5 == 1
    c = Counter(w for r in document_rows if not held(r[0]) for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    want = sorted((repr(r[0]), held(r[0]), len(tokens(r[1])), sum(c[w] > 0 for w in tokens(r[1])), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(r[1])), 6)) for r in document_rows)
    rows = sorted((repr(None if x.doc_id != x.doc_id else int(x.doc_id)), x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got.itertuples())
    assert rows == want
    short = got[got.n_tokens < 10_000]
    assert short[short.held_out].score.sum() > short[short.held_out].base_score.sum()
    assert (got.score < 0).all()
    assert hmm.score_hmm(no_documents).count() == 0
    only = hmm.score_hmm(spark.createDataFrame([(0, "a b"), (2, None)], "doc_id long, text string").where("crc32(cast(doc_id as string)) % 5 = 1"))
    assert only.where("score is null").count() == 0


def test_word_shares_sum_to_at_most_one(spark, documents):
    """P(word) over all known words and one unseen per class, given any state mixture, is at most one."""
    s = hmm.Settings(states=2, least=30, frequent=1, classes=4)
    corpus = hmm.prepare(documents.select("doc_id", "text"), "doc_id", "text", s)
    tails = corpus.docs.select("tail").collect()
    assert len(corpus.weights) == 4 and corpus.words.where("c < 30").count() == 0 and all(r["tail"] <= 1e-12 for r in tails)


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = make_rows()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    keep = brute.kept([(r[1], r[3]) for r in rows])
    docs = [r for r, k in zip(rows, keep) if k]
    lines = brute.deduped_lines([(r[0], r[1], r[3]) for r in docs])
    docs = sorted((r[0], t) for r, (t, _, _) in zip(docs, lines))
    left = set(brute.without_similar(docs))
    spans = {r["doc_id"]: [(s["start"], s["end"], pii.ALL_KINDS[s["kind"]]) for s in r["spans"]] for r in pii.with_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    texts = {k: brute.redacted(t, spans[k]) for k, t in docs if k in left}
    assert any(spans.values()) and all(set(brute.base_spans(t)) <= set(spans[k]) for k, t in docs)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(left) < sum(keep) < len(rows)
    assert check_packing(pieces, texts) > 0.5


def make_rows():
    import importlib.util
    from pathlib import Path

    spec = importlib.util.spec_from_file_location("llm_fixtures", Path(__file__).with_name("conftest.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return [r for r in module.make_documents(11, 150) if r[0] is not None and r != module.make_documents(11, 150)[-1]]


def test_stages_keep_columns_and_stand_nulls(spark, documents):
    docs = documents.withColumn("extra", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert out.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), "").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= docs.count()


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_query_equals_its_sql(name, same_as_sql):
    same_as_sql(entries.queries()[name], entries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(entries.queries()) - set(entries.oracle_sql())))
def test_query_covers_all_documents(name, spark):
    want = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").distinct().count()
    assert entries.queries()[name](spark, SF).select("doc_id").distinct().count() == want
