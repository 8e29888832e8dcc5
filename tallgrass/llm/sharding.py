"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import global_rank, materialize, ready


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Points of the virtual nodes in ring order (signed 64 bit) and the shard of each."""
    points = {int.from_bytes(xxhash.xxh64_digest(f"shard {s} node {v}"), "big", signed=True): s for s in range(shards) for v in range(vnodes)}
    at = sorted(points)
    return np.array(at, dtype=np.int64), np.array([points[p] for p in at], dtype=np.int64)


def capacities(natural: np.ndarray, rows: int, slack: float) -> np.ndarray:
    """Most rows of each shard. Without slack they sum to ``rows``, and differ by one at most: the
    shards with the most rows on their own arcs get the larger share, so that fewer rows move on."""
    shards = len(natural)
    if slack > 0:
        return np.full(shards, -(-int(rows * (1 + slack)) // shards) if rows else 0)
    cap = np.full(shards, rows // shards)
    cap[np.lexsort((np.arange(shards), -natural))[: rows % shards]] += 1
    return cap


def place(counts: np.ndarray, owner: np.ndarray, cap: np.ndarray) -> list[tuple[int, int, int]]:
    """Deal the rows of each arc: (arc, shard, rows), in the order of the arc's rows.

    An arc's first rows go to its own shard while that has room; the rest continue clockwise to the
    next virtual node whose shard isn't full.
    """
    room, arcs = cap.copy(), len(counts)
    dealt: list[list[tuple[int, int, int]]] = [[] for _ in range(arcs)]
    rest = counts.copy()
    for a in range(arcs):
        n = min(int(rest[a]), int(room[owner[a]]))
        if n:
            dealt[a].append((a, int(owner[a]), n))
            rest[a] -= n
            room[owner[a]] -= n
    for a in np.flatnonzero(rest):
        at = int(a)
        while rest[a]:
            at = (at + 1) % arcs
            n = min(int(rest[a]), int(room[owner[at]]))
            if n:
                dealt[a].append((int(a), int(owner[at]), n))
                rest[a] -= n
                room[owner[at]] -= n
    return [x for arc in dealt for x in arc]


def shard(df: DataFrame, key: str, shards: int = 40, vnodes: int = 64, slack: float = 0.0) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard) to the rows of ``df``.

    A key's ring point is its xxHash64. The driver sees one count for each arc, shards * vnodes + 1 of
    them at any input size; it deals arcs to shards and broadcasts that bounded list of runs. Rows find
    their run by their rank on the ring, so no shard's or key's rows meet in one task.
    ``slack`` 0 fills all shards to within one row; more slack moves fewer rows past their own arc.
    Null keys share one point and repeated rows are dealt like any others (spread by an ordinal, so a
    key's rows may continue into the next shard); an empty table gives an empty result; columns named
    shard or slot are replaced.
    """
    ready(df.sparkSession)
    points, owner = ring(shards, vnodes)
    arc_owner = np.append(owner, owner[0])  # rows behind the last node wrap to the first

    @F.pandas_udf("int")
    def arc_of(point: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(points, point.to_numpy(), side="left"), dtype="int32")

    keyed = df.drop("shard", "slot").withColumns({"_tg_point": F.xxhash64(key), "_tg_row": F.monotonically_increasing_id()})
    keyed = materialize(keyed.withColumn("_tg_arc", arc_of("_tg_point")), "ring")
    counts = np.zeros(len(arc_owner), dtype=np.int64)
    for r in keyed.groupBy("_tg_arc").count().collect():
        counts[r["_tg_arc"]] = r["count"]
    natural = np.bincount(arc_owner, weights=counts, minlength=shards).astype(np.int64)
    runs = place(counts, arc_owner, capacities(natural, int(counts.sum()), slack))
    sizes = np.array([n for _, _, n in runs], dtype=np.int64)
    starts = np.append(0, np.cumsum(sizes))[:-1] if runs else np.zeros(0, dtype=np.int64)
    to = np.array([s for _, s, _ in runs], dtype=np.int64)
    base, filled = np.zeros(len(runs), dtype=np.int64), np.zeros(shards, dtype=np.int64)
    for i, s in enumerate(to):
        base[i] = filled[s]
        filled[s] += sizes[i]

    @F.pandas_udf("shard int, slot long")
    def seat(rank: pd.Series) -> pd.DataFrame:
        r = rank.to_numpy()
        i = np.searchsorted(starts, r, side="right") - 1
        return pd.DataFrame({"shard": to[i].astype("int32"), "slot": base[i] + r - starts[i]})

    ranked = global_rank(keyed, ["_tg_point", key, "_tg_row"], "_tg_rank")
    return ranked.withColumn("_tg_seat", seat("_tg_rank")).select(*[c for c in df.columns if c not in ("shard", "slot")], F.col("_tg_seat.shard").alias("shard"), F.col("_tg_seat.slot").alias("slot"))


def op6_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 40 shards under the law ``rows``. A null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard(docs, "doc_id").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
