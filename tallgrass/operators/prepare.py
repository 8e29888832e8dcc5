"""Inputs checked and cleaned, and artifacts cut to a budget of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, clean_token, head_tail, issue_number, stable_id, strip
from ..types import KEY, OPTIONAL_INPUT, REQUIRED_INPUT
from .audit import alias_conflicts, blank_keys, duplicate_keys, normalized_headers, require, require_columns

_TOKENS = frozenset("repository repository_full_name repository_category issue_number type state html_url".split())
_FRAME = 35  # characters of the tags around body and comments


def resolve_aliases(df: DataFrame, a: str = "repository", b: str = "repository_full_name") -> DataFrame:
    """Fill each of two names of the repository from the other; different ones are an error."""
    if a not in df.columns and b not in df.columns:
        return df
    for have, lack in ((a, b), (b, a)):
        if lack not in df.columns:
            df = df.withColumn(lack, F.col(have))
    require(alias_conflicts(df, a, b).select(a, b), f"{a} and {b} differ")
    filled = lambda x, y: F.coalesce(F.nullif(strip(F.col(x)), F.lit("")), F.nullif(strip(F.col(y)), F.lit("")), F.lit(""))
    return df.withColumns({a: filled(a, b), b: filled(b, a)})


def validate_input(df: DataFrame, ascii_only: bool = False, checks: bool = True) -> DataFrame:
    """Clean headers and cells, fill optional columns, check the key, add ``issue_key``. Unknown columns stay."""
    df = resolve_aliases(df.toDF(*normalized_headers(df.columns)))
    require_columns(df, REQUIRED_INPUT)
    df = df.withColumns({c: F.lit("") for c in OPTIONAL_INPUT if c not in df.columns})
    df = df.select(*[(clean_token if c in _TOKENS else clean_text)(F.col(c), ascii_only).alias(c) for c in df.columns])
    df = df.withColumn("issue_number", issue_number(F.col("issue_number"), True))
    if checks:
        require(blank_keys(df, KEY).select(*KEY), "blank keys")
        require(duplicate_keys(df, KEY), "repeated keys")
    return df.withColumn("issue_key", F.concat_ws("#", *KEY))


def prepare(df: DataFrame, max_chars: int = 12_000, ascii_only: bool = False) -> DataFrame:
    """One artifact per row: the header in tags, then body and comments cut to share what is left of ``max_chars``.

    The header is never cut and the rest gets 200 characters at least, so an artifact may be longer.
    """
    col = lambda c: F.col(c) if c in df.columns else F.lit("")
    token = {n: clean_token(col(c), ascii_only) for n, c in (("repository", "repository"), ("issue_number", "issue_number"), ("artifact_type", "type"), ("state", "state"))}
    text = {n: clean_text(col(c), ascii_only) for n, c in (("title", "issue_title"), ("body", "issue_body"), ("comments", "concatenated_comments"), ("labels", "labels"))}
    df = df.select(*[v.alias(f"_{k}") for k, v in (token | text).items()])
    c = lambda n: F.col(f"_{n}")
    tag = lambda n: F.concat(F.lit(f"<{n}>"), c(n), F.lit(f"</{n}>\n"))
    df = df.withColumn("_fixed", F.concat(*map(tag, ("repository", "issue_number", "artifact_type", "state", "labels", "title"))))
    left = F.greatest(F.lit(200), F.lit(max_chars - _FRAME) - F.length("_fixed"))
    df = df.withColumn("_left", left)
    share = F.when(c("comments") == "", F.lit(1.0)).otherwise(F.lit(0.65))
    df = df.withColumn("_body_budget", F.greatest(F.lit(100), F.floor(F.col("_left") * share).cast("int")))
    body, body_cut = head_tail(c("body"), F.col("_body_budget"))
    rest = F.greatest(F.lit(0), F.col("_left") - F.col("_body_budget"))
    comments, comments_cut = head_tail(c("comments"), rest)
    df = df.withColumns({"_b": body, "_c": F.when(rest > 0, comments).otherwise(""), "input_truncated": body_cut | ((rest > 0) & comments_cut)})
    whole = sum((F.length(c(n)) for n in ("title", "body", "comments", "artifact_type", "labels", "state")), F.lit(0))
    artifact = F.concat("_fixed", F.lit("<body>"), "_b", F.lit("</body>\n<comments>"), "_c", F.lit("</comments>"))
    return df.select(
        c("repository").alias("repository"), c("issue_number").alias("issue_number"), F.concat_ws("#", c("repository"), c("issue_number")).alias("issue_key"),
        stable_id("s1", c("repository"), c("issue_number")).alias("custom_id"), artifact.alias("artifact_text"), whole.cast("long").alias("original_char_count"),
        F.length(artifact).cast("long").alias("included_char_count"), "input_truncated", c("artifact_type").alias("artifact_type"),
        F.struct(c("title").alias("title"), c("body").alias("body"), c("comments").alias("comments"), c("artifact_type").alias("type"), c("state").alias("state"), c("labels").alias("labels")).alias("source_sections"),
    )


def preparation_report(prepared: DataFrame) -> DataFrame:
    return prepared.agg(F.count("*").alias("rows"), F.count_if("input_truncated").alias("truncated_rows"), F.max("included_char_count").alias("max_chars"))


def first_rows(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first ``n`` rows by an input ordinal."""
    if n <= 0:
        raise ValueError("a limit is above zero")
    return df.orderBy(order).limit(n)
