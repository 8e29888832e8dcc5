"""Removal of boilerplate lines by the number of distinct sites that carry them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, named

_BLANK = r"^[\x20\x09-\x0D]*$"
_EDGE = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
_GAP = r"[\x20\x09-\x0D]+"


#: Lines of fewer words are taken for boilerplate only at SHORT_SITES, as chance repeats them on a few sites.
SHORT_WORDS = 5
MIN_SITES, SHORT_SITES = 3, 10
_SMALL = 500_000  # rows of 40 bytes that may be broadcast; more are shuffled


def _lines(df: DataFrame, key: str, text: str, site: str | None = None) -> DataFrame:
    """Lines with a word: key, (site,) doc (128-bit text identity), pos, n_words and the trimmed line's two hashes."""
    own = [F.col(key).alias("key"), *([F.col(site).alias("site")] if site else []), F.md5(F.col(text).cast("binary")).alias("doc")]
    lines = df.where(F.col(text).isNotNull()).select(*own, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")).where(~F.col("line").rlike(_BLANK))
    line = F.regexp_replace("line", _EDGE, "")
    kept = ["key", *(["site"] if site else []), "doc", "pos"]
    return lines.select(*kept, (F.size(F.split(line, _GAP)) < SHORT_WORDS).alias("short"), F.xxhash64(line).alias("h1"), F.xxhash64(line, F.lit(1)).alias("h2"))


def _places(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines with a word: key, doc, pos, h1, h2 and whether this is the line's first place in its text.

    First places are told in the row itself, by a sort of the text's own lines, so nothing has to be
    grouped by line afterwards and a join by line stays free to be split where a line is everywhere.
    """
    line = F.split(F.col(text), "\n")
    trimmed = F.transform(line, lambda x: F.regexp_replace(x, _EDGE, ""))
    told = F.transform(trimmed, lambda x, i: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(x, F.lit(1)).alias("h2"), i.alias("pos"), (x == "").alias("blank")))
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.md5(F.col(text).cast("binary")).alias("doc"), F.array_sort(told).alias("_tg_l"))
    again = lambda x, i: F.coalesce((F.get(F.col("_tg_l"), i - 1)["h1"] == x["h1"]) & (F.get(F.col("_tg_l"), i - 1)["h2"] == x["h2"]), F.lit(False))
    marked = F.transform("_tg_l", lambda x, i: F.struct(x["pos"].alias("pos"), x["h1"].alias("h1"), x["h2"].alias("h2"), (~again(x, i)).alias("first"), x["blank"].alias("blank")))
    return rows.select("key", "doc", F.explode(marked).alias("_tg_x")).select("key", "doc", "_tg_x.*").where("not blank").drop("blank")


def _near(x: DataFrame) -> tuple[DataFrame, bool]:
    """A stored table, marked for broadcast if its counted rows are few enough."""
    small = x.count() <= _SMALL
    return (F.broadcast(x) if small else x), small


def boilerplate(df: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, short_sites: int = SHORT_SITES, lg_k: int = 12, margin: float = 0.15) -> DataFrame:
    """Lines that enough distinct sites carry: h1, h2 and ``keeper``, the smallest key that has the line.

    Enough are ``min_sites``, for lines of fewer than SHORT_WORDS words ``short_sites``. A HyperLogLog
    sketch of each line's sites merges map-side and across tasks. Where the estimate is within
    ``margin`` of the threshold (nine standard errors at lg_k 12, and one site at least), the sites are
    counted exactly, over those lines only: equal (line, site) rows merge map-side and are dealt by both,
    so a line that stands everywhere is no single task's work. Null is one site; blank lines are no
    lines; null keys come after all others; repeated rows count once, as one site; an empty table has none.
    """
    rows = _lines(df, key, text, site)
    sites = F.coalesce(F.concat(F.lit("s"), F.col("site").cast("string")), F.lit("n"))
    spread = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.hll_sketch_estimate(F.hll_sketch_agg(sites, F.lit(lg_k))).alias("sites"), F.min("key").alias("keeper"), F.min("short").alias("short"))
    least = F.when(F.col("short"), short_sites).otherwise(min_sites)
    low, high = F.least(least * (1 - margin), least - 1), F.greatest(least * (1 + margin), least + 1)
    frequent = materialize(spread.where((F.col("n") >= least) & (F.col("sites") >= low)).select("*", least.alias("least"), (F.col("sites") > high).alias("sure")), "lines")
    near, small = _near(frequent.where("not sure").select("h1", "h2"))
    carried = rows.select("h1", "h2", sites.alias("s"))
    carried = carried.join(near, ["h1", "h2"], "left_semi").distinct() if small else carried.distinct().join(near, ["h1", "h2"], "left_semi")
    exact = carried.groupBy("h1", "h2").count()
    found = frequent.where("not sure").join(exact, ["h1", "h2"]).where("count >= least")
    return frequent.where("sure").select("h1", "h2", "keeper").unionByName(found.select("h1", "h2", "keeper"))


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, short_sites: int = SHORT_SITES, n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """``df`` with boilerplate lines taken out of ``text``, and how many lines it had and lost (long).

    A boilerplate line stays once: at its first place in the text of its smallest key. All other lines,
    blank ones included, stay as they are and in order. Null texts stay null with no lines; rows with
    the same key and text are treated alike; equal lines are told by two 64-bit hashes of the line
    without white space at its ends. Columns of ``df`` with the two names are replaced, all others stay.
    The texts are shuffled only to those documents' removed positions, by key and text.
    """
    df = df.drop(n_lines, n_removed)
    found, _ = _near(materialize(boilerplate(df, key, text, site, min_sites, short_sites), "boilerplate"))
    hits = _places(df, key, text).join(found, ["h1", "h2"])
    own = F.coalesce(F.col("key") == F.col("keeper"), F.col("key").isNull() & F.col("keeper").isNull())
    drops = hits.where(~(own & F.col("first"))).groupBy(F.col("key").alias("_tg_key"), F.col("doc").alias("_tg_doc")).agg(F.collect_set("pos").alias("_tg_gone"))
    drops = materialize(drops, "removed")
    lines = F.split(F.col(text), "\n")
    told = F.md5(F.col(text).cast("binary"))
    joined = df.withColumn("_tg_told", told).join(drops, F.col(key).eqNullSafe(F.col("_tg_key")) & (F.col("_tg_told") == F.col("_tg_doc")), "left").withColumn("_tg_lines", lines)
    stay = F.array_except(F.sequence(F.lit(0), F.size("_tg_lines") - 1), F.col("_tg_gone"))
    left = F.array_join(F.transform(stay, lambda i: F.get(F.col("_tg_lines"), i)), "\n")
    return joined.select(
        *[F.when(F.col("_tg_gone").isNull(), F.col(c)).otherwise(left).alias(c) if c == text else named(c) for c in df.columns],
        F.when(F.col(text).isNull(), 0).otherwise(F.size("_tg_lines")).cast("long").alias(n_lines),
        F.coalesce(F.size("_tg_gone"), F.lit(0)).cast("long").alias(n_removed),
    )


def op2_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines of three or more sources (ten for short lines): doc_id, n_lines, n_removed, text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
l AS (SELECT rid, doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d WHERE text IS NOT NULL),
n AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS cut FROM l),
b AS (SELECT cut, min(doc_id) AS keeper FROM n WHERE cut <> '' GROUP BY cut 
  HAVING count(DISTINCT coalesce('s' || source, 'n')) >= CASE WHEN len(regexp_extract_all(cut, '[^\x20\x09-\x0D]+')) < 5 THEN 10 ELSE 3 END),
m AS (SELECT n.rid, n.pos, n.line, b.cut IS NOT NULL AND NOT (n.doc_id IS NOT DISTINCT FROM b.keeper
  AND n.pos = min(n.pos) OVER (PARTITION BY n.rid, n.cut)) AS gone FROM n LEFT JOIN b ON n.cut = b.cut),
o AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text FROM m GROUP BY rid)
SELECT d.doc_id, coalesce(o.n_lines, 0)::BIGINT AS n_lines, coalesce(o.n_removed, 0)::BIGINT AS n_removed, o.text
FROM d LEFT JOIN o USING (rid)
"""
