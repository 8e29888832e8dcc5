"""Exact top-k by inner product with a three-phase uniform threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, ready

_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
_SAFE = float(1 << 53)


def scaled(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component x, as double. Null, with a null or non-finite component: null."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda v: _floor(v.cast("double") * scale)))


def _floor(x: Column) -> Column:
    """Floor as double at any size: doubles of 2^52 and more are whole already."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def _matrix(raw: bytes, ids: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(raw, dtype="<f8").reshape(len(ids) // 8, dims)


def _blocks(df: DataFrame, size: int) -> DataFrame:
    """Rows (id, v) packed, in each partition, into blocks of at most ``size`` vectors of one dimension."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def out(d: int) -> pd.DataFrame:
            rows = held.pop(d)
            return pd.DataFrame({"dims": [d], "ids": [np.array([i for i, _ in rows], dtype="<i8").tobytes()], "vectors": [np.concatenate([v for _, v in rows]).astype("<f8").tobytes()]})

        for pdf in batches:
            for i, v in zip(pdf["id"], pdf["v"], strict=True):
                held.setdefault(len(v), []).append((i, np.asarray(v, dtype=float)))
                if len(held[len(v)]) >= size:
                    yield out(len(v))
        for d in list(held):
            yield out(d)

    return df.mapInPandas(pack, "dims int, ids binary, vectors binary")


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products, row by row of q with c; sums that leave a long stay at its ends."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1]) < _SAFE:
        return (q @ c.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in c]
    out = [[min(_HIGH, max(_LOW, sum(int(x) * y for x, y in zip(row, other, strict=True)))) for other in whole] for row in q]
    return np.array(out, dtype=np.int64).reshape(len(q), len(c))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def top_k(df: DataFrame, key: str, vector: str, is_query: Column, k: int = 5, scale: int = 256, slices: int = 4, block: int = 1024) -> DataFrame:
    """query_id, rank (int from 1), ``key`` of the candidate, score (long) for each query's ``k`` best rows.

    The lists of scores are the partial inner products over ``slices`` runs of components. Phase one
    gathers, per block of rows, each list's k best entries with the whole scores of those rows; the k-th
    best score over all blocks is a cutoff that no answer can be under. Phase two sends the cutoff back
    to the blocks: a row can only reach it if one of its partial scores is at least cutoff / slices, so
    entries under that are dropped. Phase three resolves the exact scores of what is left where the rows
    are, and k of each block at most go on to the final ranking. Partial scores may be negative; the
    bound holds all the same, as a sum is never above ``slices`` times its largest part. The threshold
    bounds what leaves a block; the lists themselves are products of all pairs, in either pass.

    Queries and rows meet in blocks of ``block`` vectors. Each task pairs one run of stored row blocks
    with one of stored query blocks, which it reads itself, and sums up what it finds by query: blocks
    are neither broadcast nor collected, whatever their stored size makes of the plan. Vectors that
    are null or hold null or non-finite components take no part; vectors of different lengths aren't compared. A null key is no query, and
    never a candidate. Rows that share a key are candidates each, but none of their own key's query;
    a query key on several different rows asks with each. Ties go to the smaller key; scores beyond a
    long stay at its ends. An empty table gives an empty result.
    """
    spark = df.sparkSession
    ready(spark)
    ids = df.select(F.col(key).cast("long").alias("id"), scaled(F.col(vector), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("id is not null and v is not null")
    rows = materialize(ids, "vectors")
    asked = rows.where("asks").select("id", "v").distinct()
    query_blocks = max(1, -(-asked.count() // block))
    queries = _blocks(asked.repartition(query_blocks), block)
    queries = materialize(queries.select(F.monotonically_increasing_id().alias("qb"), F.col("dims").alias("qdims"), F.col("ids").alias("qids"), F.col("vectors").alias("qvectors")), "queries")
    corpus = materialize(_blocks(rows.select("id", "v"), block), "blocks")

    def met(asking: DataFrame) -> DataFrame:
        return corpus.join(asking.hint("shuffle_replicate_nl"), F.col("qdims") == F.col("dims"))

    def parts(dims: int) -> list[slice]:
        edges = np.linspace(0, dims, min(slices, max(dims, 1)) + 1).astype(int)
        return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[tuple[int, int], list[int]] = {}
        for pdf in batches:
            for r in pdf.itertuples():
                q, c = _matrix(r.qvectors, r.qids, r.dims), _matrix(r.vectors, r.ids, r.dims)
                qi, ci = np.frombuffer(r.qids, dtype="<i8"), np.frombuffer(r.ids, dtype="<i8")
                lists = [q[:, p] @ c[:, p].T for p in parts(r.dims)]
                for i in range(len(q)):
                    other = np.flatnonzero(ci != qi[i])
                    if not len(other):
                        continue
                    found = np.unique(np.concatenate([other[np.argpartition(-x[i, other], min(k, len(other)) - 1)[:k]] for x in lists]))
                    scores = exact_scores(q[i : i + 1], c[found])[0].tolist()
                    best[r.qb, i] = sorted(best.get((r.qb, i), []) + scores, reverse=True)[:k]
        found = [(qb, i, s) for (qb, i), scores in best.items() for s in scores]
        for a in range(0, len(found), 1 << 16):
            yield pd.DataFrame(found[a : a + (1 << 16)], columns=["qb", "q", "score"])

    first = met(queries).mapInPandas(gather, "qb long, q int, score long")
    at = Window.partitionBy("qb", "q").orderBy(F.desc("score"))
    cutoffs = first.withColumn("place", F.row_number().over(at)).where(F.col("place") <= k).groupBy("qb", "q").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(_LOW)).alias("cutoff"))
    cutoffs = cutoffs.groupBy("qb").agg(F.array_sort(F.collect_list(F.struct("q", "cutoff"))).alias("cutoffs"))
    sent = materialize(queries.hint("merge").join(cutoffs, "qb").repartition(query_blocks), "cutoffs")  # a block a file, as tasks hold what they read of these
    again = met(sent)
    again = again.withColumns({"at": F.transform("cutoffs", lambda x: x["q"]), "least": F.transform("cutoffs", lambda x: x["cutoff"])}).drop("cutoffs")

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                q, c = _matrix(r.qvectors, r.qids, r.dims), _matrix(r.vectors, r.ids, r.dims)
                qi, ci = np.frombuffer(r.qids, dtype="<i8"), np.frombuffer(r.ids, dtype="<i8")
                out = []
                cuts = parts(r.dims)
                lists = [q[:, p] @ c[:, p].T for p in cuts]
                for i, cutoff in zip(r.at, r.least, strict=True):
                    # a hair lower than cutoff / slices, for the rounding of huge sums
                    bar = cutoff / len(cuts) - abs(cutoff) * 1e-9 if cutoff > _LOW else -np.inf
                    over = ci != qi[i]
                    over &= np.logical_or.reduce([x[i] >= bar for x in lists])
                    found = np.flatnonzero(over)
                    if not len(found):
                        continue
                    scores = exact_scores(q[i : i + 1], c[found])[0]
                    keep = scores >= cutoff
                    found, scores = found[keep], scores[keep]
                    for j in _best(scores, ci[found], k).tolist():
                        out.append((int(qi[i]), r.qb, int(i), int(ci[found[j]]), int(scores[j])))
                yield pd.DataFrame(out, columns=["query_id", "qb", "q", "id", "score"])

    found = again.mapInPandas(resolve, "query_id long, qb long, q int, id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("qb", "q").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")


def op1_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all vectors for each whose vec_id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, "vec_id", "embedding", F.col("vec_id") % 50 == 0)


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM r WHERE k <= 5
"""
