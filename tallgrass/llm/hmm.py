"""Hidden Markov language model, trained by Baum-Welch over partitions, with exact sequence likelihood."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import new_path
from .common import materialize, ready

#: No word holds white space, so this can't be one.
END = " "
_CHUNK = 3_000_000  # tokens that share a local vocabulary and are stepped through together
_STEP = 500_000  # symbols whose forward vectors are held at once
_BLOCK = 16_384  # and their steps


@dataclass(frozen=True)
class Settings:
    """states: latent states. least, frequent: words that occur ``least`` times in the training documents, or
    that are 1/frequent of their tokens, are symbols of their own; beyond least * frequent tokens the first
    bound is the lower one, and their number grows with the corpus. classes: symbols that the rarer words share.
    rounds: passes of Baum-Welch. folds, held: a document is held out if crc32(key as text) mod folds is held."""

    states: int = 6
    least: int = 1024
    frequent: int = 4096
    classes: int = 256
    rounds: int = 4
    folds: int = 5
    held: int = 1
    seed: int = 7


def _planes(ids: np.ndarray) -> bytes:
    """The lower halves of all numbers, then the upper ones, which are few values and shrink well on disk."""
    return ids.view("<u2").reshape(-1, 2).T.tobytes()


def _whole(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype="<u2").reshape(2, -1).T).view("<i4").ravel()


def _local(path_chunks: Iterator[pd.DataFrame], folds: int, held: int) -> Iterator[pd.DataFrame]:
    """Rows of kind d: a document with its tokens as numbers in its chunk's vocabulary. Rows of kind v: that vocabulary."""
    part, k = 0, 0
    names: dict[bytes, int] = {}
    train: list[np.ndarray] = []
    docs: list[tuple] = []
    tokens = 0

    def flush() -> Iterator[pd.DataFrame]:
        nonlocal names, train, docs, tokens, k
        if not docs:
            return
        counts = np.zeros(len(names), dtype=np.int64)
        for ids in train:
            np.add.at(counts, ids, 1)
        chunk = (part << 24) + k
        frame = pd.DataFrame(docs, columns=["row", "key", "held_out", "n_tokens", "ids"])
        yield frame.assign(kind="d", chunk=chunk, local=None, word=None, count=None)
        yield pd.DataFrame({"row": None, "key": None, "held_out": None, "n_tokens": None, "ids": None, "kind": "v", "chunk": chunk, "local": range(len(names)), "word": [w.decode() for w in names], "count": counts})
        names, train, docs, tokens, k = {}, [], [], 0, k + 1

    for pdf in path_chunks:
        for row, key, name, text, p in zip(pdf["row"], pdf["key"], pdf["name"], pdf["text"], pdf["part"], strict=True):
            part = p
            words = [*(text or b"").lower().split(), END.encode()]
            get = names.setdefault
            ids = np.array([get(w, len(names)) for w in words], dtype="<i4")
            out = name is not None and zlib.crc32(name.encode()) % folds == held
            if not out:
                train.append(ids)
            docs.append((row, key, out, len(ids), _planes(ids)))
            tokens += len(ids)
            if tokens >= _CHUNK:
                yield from flush()
    yield from flush()


def localise(df: DataFrame, key: str, text: str, s: Settings) -> DataFrame:
    """The corpus as numbers: one pass over the texts, stored; a chunk has some three million tokens or one longer text."""
    spark = df.sparkSession
    ready(spark)
    kind = dict(df.dtypes)[key]
    schema = f"row long, key {kind}, held_out boolean, n_tokens long, ids binary, kind string, chunk long, local int, word string, count long"
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(key).cast("string").alias("name"), F.col(text).cast("binary").alias("text"), F.spark_partition_id().alias("part"))
    folds, held = s.folds, s.held
    return materialize(rows.mapInPandas(lambda it: _local(it, folds, held), schema), "local")


def ending_class(classes: int) -> F.Column:
    """Class of a word that isn't a symbol of its own: a hash of its last two characters, so no table is needed."""
    return F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(classes)).cast("int")


@dataclass(frozen=True)
class Corpus:
    """docs: row, key, held_out, n_tokens, n_known, base_score, tail, chunk, seq (symbols of the chunk), bucketed by
    chunk. own: chunk, sym, word, c of the words that are symbols of their own, numbered in each chunk behind the
    classes. words: word and c of all of those. The rest are counts over the training documents."""

    docs: DataFrame
    own: DataFrame
    words: DataFrame
    tokens: int
    distinct: int
    weights: np.ndarray


def _bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``df`` stored in the shared folder, dealt by ``key``: what later meets it by that key comes to it, it isn't shuffled again."""
    spark, name = df.sparkSession, f"tg_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", new_path(spark, "bucketed")).saveAsTable(name)
    return spark.table(name)


def prepare(df: DataFrame, key: str, text: str, s: Settings) -> Corpus:
    """Count words over all training documents, and turn each document into symbols and its unigram score.

    Counts are summed per chunk, then shuffled by word; they come back joined to the chunks'
    vocabularies, not to each token. Only sums over classes reach the driver.
    """
    local = localise(df, key, text, s)
    vocab = local.where("kind = 'v'").select("chunk", "local", "word", "count")
    counts = materialize(vocab.groupBy("word").agg(F.sum("count").alias("c")), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    n, v = int(total["n"]), int(total["v"] or 0)
    rare = F.col("c") < max(1, min(s.least, -(-n // s.frequent)))
    mass, kinds = np.zeros(s.classes), np.zeros(s.classes)
    for r in counts.where(rare).groupBy(ending_class(s.classes).alias("class")).agg(F.sum("c").alias("m"), F.sum((F.col("c") > 0).cast("long")).alias("k")).collect():
        mass[r["class"]], kinds[r["class"]] = r["m"], r["k"]
    base_of, class_of, classes = n + 0.5 * (v + 1), mass + 0.5 * (kinds + 1), s.classes

    known = materialize(vocab.join(counts, "word").select("chunk", "local", "c", F.when(rare, ending_class(classes)).alias("class"), F.when(~rare, F.col("word")).alias("word")), "known")
    place = F.row_number().over(Window.partitionBy("chunk").orderBy("local"))
    own = materialize(known.where("word is not null").select("chunk", "local", (place + (classes - 1)).alias("sym"), "word", "c"), "own")
    table = known.where("word is null").select(F.col("chunk").alias("of"), "local", "c", F.col("class").alias("sym")).unionByName(own.select(F.col("chunk").alias("of"), "local", "c", "sym"))
    docs = local.where("kind = 'd'").select("row", "key", "held_out", "n_tokens", "ids", "chunk")

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        at = right["local"].to_numpy()
        c, sym = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        c[at], sym[at] = right["c"].to_numpy(), right["sym"].to_numpy()
        log = np.log10(c + 0.5)
        shared = sym < classes
        base, tail = log - np.log10(base_of), np.where(shared, log - np.log10(class_of)[np.where(shared, sym, 0)], 0.0)
        seen, sym = c > 0, sym.astype("<i4")
        out = []
        for raw in left["ids"]:
            ids = _whole(raw)
            out.append((int(seen[ids].sum()), float(base[ids].sum()), float(tail[ids].sum()), _planes(sym[ids])))
        got = pd.DataFrame(out, columns=["n_known", "base_score", "tail", "seq"])
        return pd.concat([left[["row", "key", "held_out", "n_tokens", "chunk"]].reset_index(drop=True), got], axis=1)

    kind = dict(df.dtypes)[key]
    schema = f"row long, key {kind}, held_out boolean, n_tokens long, chunk long, n_known long, base_score double, tail double, seq binary"
    chunks = max(1, docs.select("chunk").distinct().count())
    scored = docs.groupBy("chunk").cogroup(table.groupBy("of")).applyInPandas(score, schema)
    stored = _bucketed(scored, "chunk", min(chunks, 20_000))
    return Corpus(stored, own.select("chunk", "sym", "word"), counts.where(~rare).select("word", "c"), n, v, mass + 0.5)


@dataclass(frozen=True)
class Model:
    """start, move, and what each state emits: the symbols that are numbered here."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


@dataclass(frozen=True)
class Trained:
    """core: the model with the classes' emissions alone, which is bounded. words: word and its probability in each
    state, a stored table that grows with the corpus and never reaches the driver."""

    core: Model
    words: DataFrame

    def on(self, own: DataFrame) -> DataFrame:
        """The rows (of, sym, word, e) of each chunk's own words."""
        return own.join(self.words, "word").select(F.col("chunk").alias("of"), "sym", "word", "e")


def _on_chunk(core: Model, right: pd.DataFrame) -> Model:
    """The model over a chunk's symbols: the classes, then its own words."""
    emit = np.zeros((len(core.start), core.emit.shape[1] + len(right)))
    emit[:, : core.emit.shape[1]] = core.emit
    if len(right):
        emit[:, right["sym"].to_numpy()] = np.stack(right["e"].to_numpy()).T
    return Model(core.start, core.move, emit)


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def _emissions(weights: DataFrame, classes: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """Probabilities from weights: of words (word, w array) in a table, of classes on the driver; each state's sum to one."""
    k = len(classes)
    sums = weights.agg(*[F.coalesce(F.sum(F.col("w")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(k)]).first()
    whole = np.array(list(sums)) + classes.sum(axis=1)
    return materialize(weights.select("word", F.array(*[F.col("w")[i] / float(whole[i]) for i in range(k)]).alias("e")), "emissions"), classes / whole[:, None]


def initial(corpus: Corpus, s: Settings) -> Trained:
    """The symbols' overall shares, tilted at random for each state (words by their hash, so that no partitioning
    matters), and states that tend to last: texts keep to a language or manner, and from there a few rounds part the states."""
    rng = np.random.default_rng(s.seed)
    uniform = lambda k, j: (F.shiftrightunsigned(F.xxhash64("word", F.lit(s.seed), F.lit(k), F.lit(j)), 11) + F.lit(1)) / F.lit(float((1 << 53) + 1))
    tilt = lambda k: -F.log(uniform(k, 0)) * F.pow(F.cos(2 * np.pi * uniform(k, 1)), 2) + 0.02  # noqa: E731  half the square of a normal number
    weights = materialize(corpus.words.select("word", F.array(*[F.col("c") * tilt(k) for k in range(s.states)]).alias("w")), "weights")
    classes = np.maximum(corpus.weights, 1e-3) * (rng.gamma(0.5, 1.0, (s.states, len(corpus.weights))) + 0.02)
    words, emit = _emissions(weights, classes)
    move = rng.uniform(0.5, 1.5, (s.states, s.states)) + 100 * np.eye(s.states)
    return Trained(Model(np.full(s.states, 1 / s.states), _normal(move), emit), words)


class _Steps:
    """Sequences (longest first) by time: at each step the symbols of those that reach it, in a row."""

    def __init__(self, seqs: list[np.ndarray]) -> None:
        lengths = np.array([len(x) for x in seqs])
        alive = len(seqs) - np.searchsorted(lengths[::-1], np.arange(int(lengths[0])), side="right")
        self.at = np.append(0, np.cumsum(alive))
        self.flat = np.empty(int(self.at[-1]), dtype=np.int32)
        for i, seq in enumerate(seqs):
            self.flat[self.at[: len(seq)] + i] = seq

    def blocks(self) -> list[tuple[int, int]]:
        """First and last step of runs of at most _BLOCK steps and some _STEP symbols."""
        out, first, steps = [], 0, len(self.at) - 1
        while first < steps:
            last = int(np.searchsorted(self.at, self.at[first] + _STEP, side="right")) - 1
            out.append((first, min(max(last, first + 1), first + _BLOCK, steps)))
            first = out[-1][1]
        return out

    def block(self, first: int, last: int) -> list[np.ndarray]:
        cuts = self.at[first : last + 1].tolist()
        return [self.flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _advance(m: Model, emit: np.ndarray, alpha: np.ndarray | None, block: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Scaled forward vectors and scales of a block's steps; ``alpha``: that of the step before."""
    ones = np.ones(len(m.start))
    for syms in block:
        alpha = emit[syms] * (m.start if alpha is None else alpha[: len(syms)] @ m.move)
        scale = alpha @ ones
        alpha /= scale[:, None]
        yield alpha, scale


def forward(m: Model, seqs: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of each sequence (longest first), by scaled forward recursion over all at once."""
    steps, logs, alpha = _Steps(seqs), np.zeros(len(seqs)), None
    emit = np.ascontiguousarray(m.emit.T)
    for run in steps.blocks():
        for alpha, scale in _advance(m, emit, alpha, steps.block(*run)):
            logs[: len(scale)] += np.log10(scale)
    return logs


def expectations(m: Model, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions of the sequences, and their log10 likelihood.

    All sequences step together. The forward vectors of one block of steps are held at a time, and one vector before each block, from
    which the others' are computed again on the way back: memory is that of a block at any length.
    """
    emit, back = np.ascontiguousarray(m.emit.T), np.ascontiguousarray(m.move.T)
    steps, log, alpha, marks, held = _Steps(seqs), 0.0, None, [], []
    runs = steps.blocks()
    for run in runs:
        marks.append(alpha)
        held = list(_advance(m, emit, alpha, steps.block(*run)))
        alpha = held[-1][0]
        log += float(sum(np.log10(scale).sum() for _, scale in held))
    moves, emits = np.zeros_like(m.move), np.zeros_like(m.emit)
    beta = np.ones_like(alpha)
    for b in range(len(marks) - 1, -1, -1):
        block = steps.block(*runs[b])
        held = held or list(_advance(m, emit, marks[b], block))
        for t in range(len(block) - 1, -1, -1):
            alpha, scale = held[t]
            before = held[t - 1][0] if t else marks[b]
            if before is not None:
                ahead = emit[block[t]]
                ahead *= beta
                ahead /= scale[:, None]
                moves += before[: len(ahead)].T @ ahead
            alpha *= beta  # from here on the state's posterior
            if before is not None:
                beta = np.ones_like(before)
                np.matmul(ahead, back, out=beta[: len(ahead)])
        flat, gammas = np.concatenate(block), np.concatenate([x for x, _ in held])
        for k in range(len(m.start)):
            emits[k] += np.bincount(flat, weights=gammas[:, k], minlength=emits.shape[1])
        starts, held = held[0][0].sum(axis=0), []
    return starts, moves * m.move, emits, log


def baum_welch(corpus: Corpus, t: Trained, floor: float = 1e-2) -> tuple[Trained, float]:
    """One round over all training documents; returns the new model and the old one's log10 likelihood.

    Each chunk meets the emissions of its own words, and sends back expected counts: of words as
    (word, one count a state), which Spark sums by word into the next table of emissions; of starts,
    moves and classes as (state, cell, value), of which the driver gets states * (1 + states + classes)
    sums at any input size.
    """
    core, k, classes = t.core, len(t.core.start), t.core.emit.shape[1]
    schema = "state int, cell int, value double, word string, w array<double>"

    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"state": [], "cell": [], "value": [], "word": [], "w": []})
        m = _on_chunk(core, right)
        starts, moves, emits, log = expectations(m, sorted(map(_whole, left["seq"]), key=len, reverse=True))
        cells = np.concatenate([starts[:, None], moves, emits[:, :classes]], axis=1)
        state, cell = np.nonzero(cells)
        sums = pd.DataFrame({"state": np.append(state, -1), "cell": np.append(cell, 0), "value": np.append(cells[state, cell], log), "word": None, "w": None})
        words = pd.DataFrame({"state": -2, "cell": 0, "value": 0.0, "word": right["word"], "w": list(emits[:, right["sym"].to_numpy()].T) if len(right) else []})
        return pd.concat([sums, words], ignore_index=True) if len(words) else sums

    left, right = corpus.docs.where("not held_out").select("chunk", "seq"), t.on(corpus.own)
    counted = materialize(left.groupBy("chunk").cogroup(right.groupBy("of")).applyInPandas(count, schema), "expected")
    cells, log = np.zeros((k, 1 + k + classes)), 0.0
    for r in counted.where("state >= -1").groupBy("state", "cell").agg(F.sum("value").alias("value")).collect():
        if r["state"] < 0:
            log = r["value"]
        else:
            cells[r["state"], r["cell"]] = r["value"]
    by_word = counted.where("state = -2").groupBy("word").agg(F.array(*[F.sum(F.col("w")[i]) + floor for i in range(k)]).alias("w"))
    words, emit = _emissions(materialize(by_word, "weights"), cells[:, 1 + k :] + floor)
    return Trained(Model(_normal(cells[:, 0] + floor), _normal(cells[:, 1 : 1 + k] + floor), emit), words), log


def score_hmm(df: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """One row per row of ``df``: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trained on the documents that aren't held out. Tokens are the ASCII-lower-cased words and one end;
    score is log10 P(text): the exact likelihood of the symbols by the forward recursion, times for each
    word that shares a symbol its smoothed share among that symbol's words. A null key is a training
    document, a null text an empty one (its end only); repeated rows count and are scored each; an
    empty table gives an empty result, and a corpus with nothing to train on the untrained start model.
    """
    corpus = prepare(df, key, text, settings)
    model = initial(corpus, settings)
    for _ in range(settings.rounds if corpus.tokens else 0):
        model, _ = baum_welch(corpus, model)
    return _scores(corpus, model, key)


def _scores(corpus: Corpus, t: Trained, key: str) -> DataFrame:
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        m, log, seqs = _on_chunk(core, right), np.zeros(len(left)), [_whole(x) for x in left["seq"]]
        order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
        if order:
            log[order] = forward(m, [seqs[i] for i in order])
        return left[names].assign(hmm=log)

    core, names = t.core, ["key", "held_out", "n_tokens", "n_known", "base_score", "tail"]
    kind = dict(corpus.docs.dtypes)["key"]
    schema = f"key {kind}, held_out boolean, n_tokens long, n_known long, base_score double, tail double, hmm double"
    scored = corpus.docs.select(*names, "chunk", "seq").groupBy("chunk").cogroup(t.on(corpus.own).groupBy("of")).applyInPandas(run, schema)
    return scored.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(corpus.tokens).cast("long").alias("train_tokens"), "base_score", (F.col("hmm") + F.col("tail")).alias("score"))


def op10_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under the unigram base and the hidden Markov model."""
    return score_hmm(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
