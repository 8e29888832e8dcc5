"""Ledgers as streams: replays dropped, figures per window, results replaced batch by batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import REPLAY
from ..operators.stages import upsert
from ..scratch import materialize, new_path
from ..sources.sinks import exists, write_table
from ..types import LEDGER


def stream_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """New ledger files of a folder as they come; ``at`` is the time of a call."""
    return spark.readStream.schema(LEDGER).json(folder).withColumn("at", F.to_timestamp("timestamp"))


def without_replays(calls: DataFrame, identity: Sequence[str] = REPLAY, time: str = "at", late: str = "1 day") -> DataFrame:
    """First rows of each identity; state older than ``late`` is dropped."""
    return calls.withWatermark(time, late).dropDuplicatesWithinWatermark(list(identity))


def windowed(calls: DataFrame, time: str, every: str, by: Sequence[str], late: str = "1 day") -> DataFrame:
    """Calls per window and group; in append mode a window comes out once it can't change any more."""
    out = calls.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), *by).agg(F.count("*").alias("calls"))
    return out.select(F.col("w.start").alias("start"), *by, "calls")


def upsert_stream(results: DataFrame, path: str, key: Sequence[str], checkpoint: str, order: str | None = None, parts: int = 64):
    """Keep a table of the latest result of each key, the one with the largest ``order`` (any of them if none is
    named); a batch that is run again changes nothing, and a late row doesn't replace a later one.

    The table lies in ``parts`` folders by a hash of the key. A batch writes those anew that its keys fall
    into and leaves the others alone.
    """
    def latest(rows: DataFrame) -> DataFrame:
        best = F.max_by(F.struct(*rows.columns), F.struct(order, F.xxhash64(*rows.columns)) if order else F.xxhash64(*rows.columns))
        return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(best.alias("_r")).select("_r.*")

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")
        new = materialize(latest(batch).withColumn("_part", part), "batch")
        for r in new.select("_part").distinct().orderBy("_part").collect():  # at most ``parts`` numbers
            at, own = f"{path}/_part={r['_part']}", new.where(F.col("_part") == r["_part"]).drop("_part")
            old = spark.read.parquet(at) if exists(spark, at) else None
            if old is None:
                write_table(own, at)
            else:
                write_table(latest(old.unionByName(own)) if order else upsert(old, own, key), at)

    return results.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Process what is there now; returns the last state, or in append mode all rows, as a table (of the size of the result)."""
    spark = stream.sparkSession
    out = new_path(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        write_table(batch, f"{out}/rows/part-of-{number if mode == 'append' else 'all'}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{out}/rows") if exists(spark, f"{out}/rows") else spark.createDataFrame([], stream.schema)
