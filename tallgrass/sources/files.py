"""Files read with their odd encodings, delimiters and headers, and with the checks they need."""

from __future__ import annotations

import csv
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_scalar, label_number, part_of, split_multivalue
from ..operators.audit import Violation, blank_keys, duplicate_keys, normalized_headers, require, require_columns
from ..operators.prepare import validate_input
from ..operators.vocab import canonicalize, vocabulary
from ..types import KEY, LEDGER, PAIR_KEY, SUCCEEDED

_HEAD = 1 << 16
_LATIN = "".join(chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
_WINDOWS = bytes(map(ord, _LATIN)).decode("cp1252")


def encoding_of(head: bytes, valid: bool) -> str:
    """UTF-8 (with or without a byte-order mark) if the whole file is valid as such, else CP1252."""
    if head.startswith(b"\xef\xbb\xbf") and valid:
        return "utf-8-sig"
    return "utf-8" if valid else "windows-1252"


def delimiter_of(text: str) -> str:
    """Comma, semicolon or tab, as the sample reads; else the most frequent of them in its first line."""
    try:
        return csv.Sniffer().sniff(text, delimiters=",;\t").delimiter
    except csv.Error:
        first = text.splitlines()[0] if text else ""
        best = max(",;\t", key=first.count)
        return best if first.count(best) else ","


def probe(spark: SparkSession, path: str) -> tuple[str, str]:
    """Encoding and delimiter of a file: its first 64 KiB reach the driver, its validity is checked where it is read."""
    content = F.col("content")
    row = spark.read.format("binaryFile").load(path).select(F.substring(content, 1, _HEAD).alias("head"), F.is_valid_utf8(content.cast("string")).alias("valid")).first()
    if row is None:
        raise Violation(f"no file at {path}")
    head = bytes(row["head"])
    encoding = encoding_of(head, row["valid"])
    return encoding, delimiter_of(head.decode("cp1252" if encoding.startswith("win") else "utf-8-sig", "replace"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, missing cells blank, headers in snake case; quoted cells may hold line breaks."""
    encoding, sep = probe(spark, path)
    utf8 = encoding.startswith("utf")
    df = spark.read.csv(path, header=True, sep=sep, encoding="UTF-8" if utf8 else "ISO-8859-1", multiLine=True, quote='"', escape='"', inferSchema=False)
    if not utf8:  # the two differ in the bytes 0x80 to 0x9F only
        df = df.select(*[F.translate(F.col(f"`{c}`"), _LATIN, _WINDOWS).alias(c.translate(str.maketrans(_LATIN, _WINDOWS))) for c in df.columns])
    return df.toDF(*normalized_headers(df.columns)).na.fill("")


def load_input(spark: SparkSession, path: str) -> DataFrame:
    return validate_input(read_csv(spark, path))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """One row per line that isn't blank."""
    return spark.read.schema(LEDGER).json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def compact_resource(spark: SparkSession, path: str) -> DataFrame:
    """(pattern, pattern_id, short_definition, source_description_sha256) of a JSON file with version and patterns."""
    rows = spark.read.option("multiLine", True).schema("version string, patterns map<string, struct<pattern_id: string, short_definition: string, source_description_sha256: string>>").json(path)
    return rows.select(F.explode("patterns").alias("pattern", "v")).select("pattern", "v.*")


def read_results(spark: SparkSession, path: str, stage: int) -> DataFrame:
    """A stored result table, checked: keys given and unique, lists of candidates readable, verdicts given.

    Tables from before there was a request_status hold successes only.
    """
    df = read_csv(spark, path)
    key = KEY if stage == 1 else PAIR_KEY
    require_columns(df, key)
    if "request_status" not in df.columns:
        df = df.withColumn("request_status", F.lit(SUCCEEDED))
    require(blank_keys(df, key).select(*key), "blank keys")
    require(duplicate_keys(df, key), "repeated keys")
    done = df.where(F.col("request_status") == SUCCEEDED)
    if stage == 1 and "candidates" in df.columns:
        require(done.where(F.from_json("candidates", "array<string>").isNull()).select(*key, "candidates"), "candidates are no JSON list")
    if stage == 2 and "verdict" in df.columns:
        require(done.where(clean_scalar(F.col("verdict")) == "").select(*key), "blank verdicts")
    return df


def human_gold(issues: DataFrame, names: list[str], pairs: DataFrame | None = None, annotator: str = "A1") -> tuple[DataFrame, DataFrame]:
    """Strict and uncertain pairs (repository, issue_number, pattern) of human labels.

    Cells may hold several annotators' parts. A table of pairs, if there is one, replaces what the issues say.
    """
    spark = issues.sparkSession
    words = vocabulary(spark, names)
    if pairs is not None:
        rows = canonicalize(pairs.withColumn("issue_number", label_number(F.col("issue_number"))), "pattern", words, out="name")
        require(rows.where("not known").select(*PAIR_KEY), "unknown patterns")
        verdict = F.lower(part_of(clean_scalar(F.col("human_verdict")), annotator))
        rows = rows.select("repository", "issue_number", F.col("name").alias("pattern"), verdict.alias("v"))
        return rows.where("v = 'yes'").drop("v").distinct(), rows.where("v in ('uncertain', 'insufficient_context')").drop("v").distinct()

    def listed(column: str) -> DataFrame:
        cell = part_of(clean_scalar(F.col(column)), annotator)
        rows = issues.select("repository", label_number(F.col("issue_number")).alias("issue_number"), F.explode(split_multivalue(cell)).alias("given"))
        found = canonicalize(rows, "given", words, out="pattern")
        require(found.where("not known").select("repository", "issue_number", "given"), f"unknown patterns in {column}")
        return found.select(*PAIR_KEY).distinct()

    return listed("patterns_confirmed"), listed("patterns_uncertain")


def schema_from(path: str) -> dict:
    """A JSON schema of the driver's own."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, modified, sha256) of files, hashed where they are read."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))
