"""Near-duplicates of the pipeline against brute-force Jaccard similarity of five-word runs."""

from __future__ import annotations

import random

import brute
import numpy as np

import corpus_pipeline
from tallgrass.llm import simhash


def make_texts(n=220, seed=5):
    """Texts of common and rare words; copies with some words changed, and chains of such copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(40)]
    texts = [[rng.choice(words) for _ in range(rng.randint(60, 300))] + rng.choice([[], passage]) for _ in range(30)]
    while len(texts) < n:
        w = list(rng.choice(texts))
        for _ in range(rng.randint(0, max(1, len(w) // 40))):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(w)
    return [(i, " ".join(w)) for i, w in enumerate(texts)] + [(n, None), (n + 1, " "), (n + 2, "A b"), (n + 3, "a  B")]


def test_stage_equals_brute_force(spark):
    rows = make_texts()
    sets = [brute.runs(t) for _, t in rows]
    near = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a != b]
    assert sum(0.8 <= x < 0.9 for x in near) > 20 and sum(0.7 <= x < 0.8 for x in near) > 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    left, want = {r[0] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}, set(brute.without_similar(rows))
    assert want <= left and len(left - want) <= 0.05 * (len(rows) - len(want))  # pairs right at the bound meet in 95 of 100 cases


def test_recall_of_lone_pairs(spark):
    """Pairs right above the bound, with no group to help: nearly all are found, and nothing else goes."""
    rng = random.Random(9)
    rows, near = [], 0
    for i in range(150):
        w = [f"v{rng.randrange(3000)}" for _ in range(rng.randint(80, 200))]
        other = list(w)
        for j in rng.sample(range(len(w)), max(1, len(w) // 50)):
            other[j] = "changed"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]
        near += len(brute.runs(rows[-1][1]) & brute.runs(rows[-2][1])) >= 0.8 * len(brute.runs(rows[-1][1]) | brute.runs(rows[-2][1]))
    left = {r[0] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = set(brute.without_similar(rows))
    assert near > 100 and want <= left and len(left - want) <= 0.05 * near


def test_no_pair_at_the_bound_is_left_out(spark):
    """Lone pairs at 0.80 to 0.82, many with a passage that hundreds of texts share: each one is found, and nothing else goes."""
    rng = random.Random(21)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    while len(rows) < 600:
        w = [f"v{rng.randrange(5000)}" for _ in range(rng.randint(100, 160))] + passage * rng.randint(0, 1)
        other = list(w)
        for j in range(rng.randint(3, 20), len(w), rng.randint(45, 60)):
            other[j] = "changed"
        a, b = brute.runs(" ".join(w)), brute.runs(" ".join(other))
        if 0.8 <= len(a & b) / len(a | b) <= 0.82:
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(other))]
    left = sorted(r[0] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert left == brute.without_similar(rows) == list(range(0, 600, 2))


def test_prefix_pairs_in_any_order_of_hashes(spark):
    """With each order, the prefixes alone bring all pairs at the threshold together, but for those of one root."""
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(40):
        x = rng.choice(60, rng.integers(1, 40), replace=False)
        sets += [np.unique(x), np.unique(np.append(x[: max(1, len(x) - rng.integers(0, 4))], rng.integers(60)))]
    roots = {i: i % 7 for i in range(0, 80, 3)}
    want = {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if 100 * len(np.intersect1d(a, b)) >= 70 * len(np.union1d(a, b)) and roots.get(i, i) != roots.get(j, j)}
    assert len(want) > 25
    rooted = spark.createDataFrame(list(roots.items()), "node long, root long")
    for common in ([], [3, 8, 9, 41], range(60)):
        common = np.array(common, dtype=np.int64)
        place = rng.permutation(len(common))
        rows = [(i, len(x), simhash.bitmap(x).tolist(), [int(y) for y in simhash.rare_first(x, common, place)[: len(x) - -(-70 * len(x) // 100) + 1]]) for i, x in enumerate(sets)]
        got = {tuple(r) for r in simhash.prefix_pairs(spark.createDataFrame(rows, "node long, n int, bits array<long>, x array<long>"), rooted, 70).collect()}
        assert want <= got and all(i < j and roots.get(i, i) != roots.get(j, j) for i, j in got)


def test_rows_without_a_key_are_told_apart(spark):
    texts = [" ".join(f"t{i}w{j}" for j in range(30)) for i in range(5)]
    rows = [(None, t, "a") for t in texts] + [(None, texts[0], "b"), (4, texts[1], "c"), (None, None, "d"), (None, " ", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _c string").coalesce(1)
    left = sorted((r["doc_id"] is None, r["text"] or "", r["_c"]) for r in simhash.drop_near_duplicates(df).collect())
    assert left == sorted([(True, texts[0], "a"), (False, texts[1], "c"), (True, texts[2], "a"), (True, texts[3], "a"), (True, texts[4], "a"), (True, "", "d")])


def test_large_group_of_near_copies(spark):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(600):
        w = list(base)
        for j in rng.sample(range(len(w)), 1):
            w[j] = f"x{i}"
        rows.append((i, " ".join(w)))
    assert [r[0] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == brute.without_similar(rows[:60])


def test_codes(spark):
    c = simhash.Codes.of(10_000)
    assert c.bits == 28 and simhash.Codes.of(10**9).bits == 40 and simhash.Codes.of(10**9).tables > c.tables
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(-(1 << 62), 1 << 62, 40_000))
    bits = np.concatenate([np.unpackbits(simhash._mixed(x.view(np.uint64), w).reshape(-1, 1).view(np.uint8), axis=1) for w in range(-(-c.bits * c.tables // 64))], axis=1)
    ones = 2 * bits.sum(axis=0) > len(x)
    want = [(t << c.bits) | sum(int(ones[t * c.bits + i]) << i for i in range(c.bits)) for t in range(c.tables)]
    assert simhash.simhash_codes(x, c) == want
