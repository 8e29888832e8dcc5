"""How many tasks a table is dealt to, so that a task's share stays the same as the table grows."""

from __future__ import annotations

from pyspark.sql import DataFrame

_UNKNOWN = 1 << 60  # Spark's size of what it can't tell the size of
_MOST = 20_000
_DEALT = 2.0  # megabytes; Spark takes over a number of tasks for a join only if it is no smaller than its own


def read_bytes(df: DataFrame) -> int | None:
    """Bytes of the tables that ``df`` reads, by Spark's estimate; null where it has none."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return None if any(s >= _UNKNOWN for s in sizes) else sum(sizes)


def tasks(df: DataFrame, megabytes: float = 8) -> int:
    """A number of tasks that take ``megabytes`` of what ``df`` reads each, and no fewer than there are cores.

    Given to repartition it also keeps adaptive execution from merging them to tasks of 64 compressed megabytes.
    """
    spark = df.sparkSession
    size, cores = read_bytes(df), spark.sparkContext.defaultParallelism
    if size is None:
        return max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return min(_MOST, max(cores, -int(-size // (megabytes * 1_000_000))))


def dealt(df: DataFrame, *keys: str, like: DataFrame | None = None) -> DataFrame:
    """``df`` dealt by key to tasks of a bounded size (to as many as ``like`` is dealt to, so that both meet where they are)."""
    return df.repartition(tasks(df if like is None else like, _DEALT), *keys)
