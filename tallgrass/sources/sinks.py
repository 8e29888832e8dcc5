"""Tables and small documents written so that a reader never sees half of one."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.audit import Violation, same_rows


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", replace: bool = True, **options: object) -> None:
    """Write beside ``path``, then rename. The old table is moved aside before and deleted after, so it is never
    lost: a failure between leaves it whole under ``path``.old-... (a plain file system can't swap two folders)."""
    spark = df.sparkSession
    if not replace and exists(spark, path):
        raise Violation(f"{path} exists")
    stage = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex[:8]}"
    df.write.format(fmt).options(**options).save(stage)
    fs, p, jvm = _fs(spark, path)
    aside = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.old-{uuid.uuid4().hex[:8]}")
    moved = fs.exists(p) and fs.rename(p, aside)
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(stage), p):
        if moved:
            fs.rename(aside, p)
        raise OSError(f"can't rename to {path}")
    if moved:
        fs.delete(aside, True)


def write_csv(df: DataFrame, path: str, replace: bool = True) -> None:
    write_table(df, path, "csv", replace, header=True, quote='"', escape='"', encoding="UTF-8")


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_requests(df: DataFrame, path: str) -> None:
    """One JSON object a line, without sending anything."""
    write_table(df.select(F.to_json(F.struct(*df.columns)).alias("value")), path, "text")


def ensure_table(spark: SparkSession, path: str, schema: T.StructType | str) -> None:
    """An empty table if there is none."""
    if not exists(spark, path):
        write_table(spark.createDataFrame([], schema), path)


def write_document(spark: SparkSession, path: str, value: object) -> None:
    """A small JSON document, keys sorted, as one line of text."""
    write_table(spark.createDataFrame([(json.dumps(value, sort_keys=True, ensure_ascii=False, default=str),)], "value string").coalesce(1), path, "text")


def read_document(spark: SparkSession, path: str) -> object:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def write_once(df: DataFrame, path: str) -> None:
    """Write, or check that what is there has the same rows."""
    if not exists(df.sparkSession, path):
        write_table(df, path)
    elif not same_rows(df, df.sparkSession.read.parquet(path)):
        raise Violation(f"{path} was written with other settings")


def save_manifest(spark: SparkSession, folder: str, documents: dict[str, object], tables: dict[str, DataFrame]) -> None:
    """What a run started from: snapshots and audits as tables, settings and digests as documents. Written once."""
    for name, df in tables.items():
        write_once(df, f"{folder}/{name}")
    for name, value in documents.items():
        path = f"{folder}/{name}.json"
        if not exists(spark, path):
            write_document(spark, path, value)
        elif read_document(spark, path) != json.loads(json.dumps(value, default=str)):
            raise Violation(f"{path} was written with other settings")
