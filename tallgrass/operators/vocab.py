"""Closed vocabularies: values are matched by name or by fingerprint."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_display, fingerprint, split_multivalue
from .audit import require

_BROADCAST_ROWS = 10_000


def vocabulary(spark: SparkSession, names: Iterable[str]) -> DataFrame:
    """(canonical, fp) of a list of names."""
    return spark.createDataFrame([(n,) for n in names], "canonical string").withColumn("fp", fingerprint(F.col("canonical")))


def collisions(names: DataFrame, column: str = "canonical", ascii_only: bool = False) -> DataFrame:
    """Fingerprints that different names share."""
    fp = fingerprint(F.col(column), ascii_only)
    return names.select(F.col(column).alias("canonical"), fp.alias("fp")).distinct().groupBy("fp").agg(F.count("*").alias("names"), F.min("canonical").alias("first"), F.max("canonical").alias("last")).where("names > 1")


def _lookup(names: DataFrame, column: str, ascii_only: bool) -> DataFrame:
    found = names.select(F.col(column).alias("canonical"), fingerprint(F.col(column), ascii_only).alias("_fp")).distinct()
    small = found.limit(_BROADCAST_ROWS + 1).count() <= _BROADCAST_ROWS  # a checked bound; beyond it Spark decides
    return F.broadcast(found) if small else found


def canonicalize(df: DataFrame, column: str, names: DataFrame, name: str = "canonical", out: str = "canonical", ascii_only: bool = False, allow_blank: bool = False) -> DataFrame:
    """Add the canonical name (null if there is none) and ``known``. A blank is known only if allowed.

    Equal display forms have equal fingerprints, so one equi-join on fingerprints serves both matches.
    """
    shown = canonical_display(F.col(column), ascii_only)
    keyed = df.withColumn("_fp", fingerprint(F.col(column), ascii_only))
    joined = keyed.join(_lookup(names, name, ascii_only).withColumnRenamed("canonical", "_name"), "_fp", "left").drop("_fp")
    known = F.col("_name").isNotNull()
    return joined.withColumns({"known": F.when(shown == "", F.lit(allow_blank)).otherwise(known), out: F.when(shown == "", F.lit("") if allow_blank else F.lit(None)).otherwise(F.col("_name"))}).drop("_name")


def canonicalize_multivalue(df: DataFrame, key: Sequence[str], column: str, names: DataFrame, name: str = "canonical", ascii_only: bool = False, strict: bool = False) -> DataFrame:
    """(key, values): the cell's parts by canonical name, in order, first of equals kept; parts without a name are
    left out, or an error if ``strict``."""
    parts = df.select(*key, F.posexplode(split_multivalue(F.col(column), ascii_only)).alias("pos", "part"))
    found = canonicalize(parts, "part", names, name, ascii_only=ascii_only)
    if strict:
        require(found.where("not known"), f"unknown values in {column}")
    return found.where("known").groupBy(*key).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "canonical"))), lambda x: x["canonical"])).alias("values"))
