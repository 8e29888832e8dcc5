"""Assertions as data: each operator returns the rows that break its rule; ``require`` raises on them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import header_name, strip


class Violation(ValueError):
    """An input breaks a rule; the message holds up to ten examples."""


def require(violations: DataFrame, what: str) -> None:
    """Raise if there is any row; at most ten reach the driver."""
    if rows := violations.distinct().limit(10).collect():
        raise Violation(f"{what}: " + "; ".join(str(r.asDict()) for r in rows))


def missing_columns(df: DataFrame, needed: Iterable[str]) -> list[str]:
    return sorted(set(needed) - set(df.columns))


def require_columns(df: DataFrame, needed: Iterable[str]) -> None:
    if gone := missing_columns(df, needed):
        raise Violation(f"missing columns: {', '.join(gone)}")


def normalized_headers(names: Sequence[str]) -> list[str]:
    """Snake-case headers; two that become equal are an error."""
    new = [header_name(n) for n in names]
    if clash := sorted({n for n in new if new.count(n) > 1}):
        raise Violation(f"headers become equal: {', '.join(clash)}")
    return new


def blank_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows with a key part that is null or blank."""
    bad = F.lit(False)
    for k in key:
        bad = bad | F.coalesce(strip(F.col(k).cast("string")) == "", F.lit(True))
    return df.where(bad)


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys on more than one row, with the number of rows. Counted map-side: a hot key is one row a task."""
    return df.groupBy(*key).count().where("count > 1")


def rows_with_duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """All rows whose key is on more than one row."""
    return df.join(duplicate_keys(df, key).drop("count"), list(key), "left_semi")


def alias_conflicts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose two names of one thing are both given and differ."""
    filled = lambda c: F.coalesce(strip(F.col(c)), F.lit(""))
    return df.where((filled(a) != "") & (filled(b) != "") & (filled(a) != filled(b)))


def unmatched(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys of ``left`` that ``right`` hasn't."""
    return left.select(*key).distinct().join(right, list(key), "left_anti")


def key_difference(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys in one table only, with the side; none if the key sets are equal."""
    return unmatched(a, b, key).withColumn("side", F.lit("left")).unionByName(unmatched(b, a, key).withColumn("side", F.lit("right")))


def one_to_one(left: DataFrame, right: DataFrame, key: Sequence[str]) -> None:
    """Both sides have each key once, and the right one has every key of the left."""
    require(duplicate_keys(left, key), "repeated keys on the left")
    require(duplicate_keys(right, key), "repeated keys on the right")
    require(unmatched(left, right, key), "keys without a match")


def changes(before: DataFrame, after: dict[str, tuple[Column, str]], key: Sequence[str], scope: str) -> DataFrame:
    """Long audit of changed cells: key, column, scope, reason, previews of up to 160 characters and digests of both sides.

    ``after`` has a new value and a reason for each column. One pass, no join: the cells are unpivoted in the row.
    """
    cell = lambda c, new, why: F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("before"), new.cast("string").alias("after"), F.lit(why).alias("reason"))
    cells = before.select(*key, F.explode(F.array(*[cell(c, new, why) for c, (new, why) in after.items()])).alias("x")).select(*key, "x.*")
    filled = lambda c: F.coalesce(F.col(c), F.lit(""))
    changed = cells.where(filled("before") != filled("after"))
    preview = lambda c: F.substring(F.replace(F.replace(filled(c), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), 1, 160)
    return changed.select(*key, "column", F.lit(scope).alias("scope"), "reason", *[f(c).alias(f"{c}_{n}") for c in ("before", "after") for n, f in (("preview", preview), ("sha256", lambda c: F.sha2(filled(c), 256)))])


def change_summary(audit: DataFrame) -> DataFrame:
    """Counts by reason and by scope in one pass of grouping sets."""
    sets = audit.groupingSets([["reason"], ["scope"]], "reason", "scope").agg(F.count("*").alias("changes"))
    return sets.select(F.when(F.col("reason").isNotNull(), "reason").otherwise("scope").alias("by"), F.coalesce("reason", "scope").alias("value"), "changes")


def differing_settings(a: DataFrame, b: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """Settings (name, value) that differ between two runs; one that a side lacks differs."""
    x, y = a.select(name, F.col(value).alias("left")), b.select(name, F.col(value).alias("right"))
    return x.join(y, name, "full").where(~F.col("left").eqNullSafe(F.col("right")))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as bags."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def broken_checkpoints(states: DataFrame) -> DataFrame:
    """Progress records with repeated ids, or ids both completed and failed."""
    repeated = lambda c: F.size(F.array_distinct(c)) != F.size(c)
    return states.where(repeated("completed_ids") | repeated("failed_ids") | F.arrays_overlap("completed_ids", "failed_ids"))


def resume_conflicts(old: DataFrame, new: DataFrame, aliases: dict[str, str] | None = None, name: str = "name", value: str = "value") -> DataFrame:
    """Settings (name, value) that an earlier run recorded and a resumed one would change.

    Settings that the old record lacks don't count; values that ``aliases`` maps to one are equal.
    """
    mapped = lambda c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), F.col(c)), F.col(c)) if aliases else F.col(c)
    x = old.select(name, F.col(value).alias("old"))
    y = new.select(name, F.col(value).alias("new"))
    return x.join(y, name, "left").where(~mapped("old").eqNullSafe(mapped("new")))
