"""Shared plumbing of the training-data operators: row links and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize, release, shared_dir
from ..workers import ready

__all__ = ["WORD", "components", "global_rank", "materialize", "named", "own_columns", "ready", "release", "shared_dir"]

#: Words of the contracts: maximal runs without ASCII white space. bytes.split() cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"


def named(c: str) -> Column:
    """The column of that name, whatever signs it holds."""
    return F.col("`" + c.replace("`", "``") + "`").alias(c)


def own_columns(df: DataFrame) -> list[Column]:
    return [named(c) for c in df.columns]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (u long, v long), as (node, root) with the smallest node as root.

    Alternates large-star and small-star contraction; each round is written to the shared folder.
    Minima are aggregated map-side before the join back, so a node that touches a third of the
    edges is a splittable skewed join and never one task's group. Nodes without an edge are absent.
    """
    def canonical(e: DataFrame) -> DataFrame:
        return e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    e = materialize(canonical(edges), "edges")
    seen = mark(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(canonical(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = materialize(canonical(small), "edges")
        now = mark(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Number the rows of ``df`` from 0 in ``order`` without bringing them to one task.

    Rows are dealt by range and each range is numbered on its own, after the sum of the ranges before it.
    ``order`` should end in something that tells repeated rows apart, so that no range is one value.
    """
    dealt = materialize(df.repartitionByRange(*order).withColumn("_tg_part", F.spark_partition_id()), "ranges")
    ahead = Window.orderBy("_tg_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_tg_part").count().select("_tg_part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_tg_before"))
    inside = F.row_number().over(Window.partitionBy("_tg_part").orderBy(*order))
    return dealt.withColumn(name, inside - 1).join(F.broadcast(offsets), "_tg_part").withColumn(name, (F.col(name) + F.col("_tg_before")).cast("long")).drop("_tg_part", "_tg_before")
