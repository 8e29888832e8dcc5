"""Quality rules of documents with host-level verdicts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, materialize, own_columns

#: Rules of a document, and of those the soft ones, in which the host has a say.
RULES = ("short", "repetitive", "symbols", "lines", "lengths")
SOFT = ("symbols", "lines", "lengths")
_POS = 20  # low bits of a packed window that hold its position
_NO_LONGS = "cast(array() as array<bigint>)"


def held(df: DataFrame, text: str, host: str) -> DataFrame:
    """``df`` with its columns out of the way of added ones: _tg_own (all of them), _tg_text, _tg_host_of."""
    every = own_columns(df)
    return df.select(F.struct(*every).alias("_tg_own"), df[text].alias("_tg_text"), df[host].alias("_tg_host_of"))


def with_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) of the whole text; null counts as empty.

    Repeated three-word windows are found in the row itself: window hashes, cut to leave room for
    their positions, go through a primitive sort; the few that look repeated are compared again by
    their full 64-bit hash. Texts of 2^20 words and more skip the first step.
    """
    words, t = F.col("_tg_w"), F.coalesce(F.col(text), F.lit(""))
    n, low = F.size(words), (1 << _POS) - 1
    has_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    df = df.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    own = [F.col(c) for c in df.columns]

    def at(array: str, i: Column) -> Column:
        return F.get(F.col(array), i)

    def same(array: str, i: Column, part) -> Column:
        return F.coalesce(part(at(array, i - 1)) == part(at(array, i)), F.lit(False)) | F.coalesce(part(at(array, i + 1)) == part(at(array, i)), F.lit(False))

    step = df.select(*own, F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("_tg_w"), F.filter(F.split(t, "\n"), has_word).alias("_tg_l"))
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(at("_tg_w", i), at("_tg_w", i + 1), at("_tg_w", i + 2)))
    step = step.select(
        *own,
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_tg_l") - F.size(F.array_distinct("_tg_l"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, windows).otherwise(F.expr(_NO_LONGS)).alias("_tg_g"),
    )
    base = [*own, *map(F.col, ("n_words", "word_chars", "n_symbols", "n_dup_lines"))]
    packed = F.sort_array(F.transform("_tg_g", lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))
    step = step.select(*base, "_tg_g", F.when(F.size("_tg_g") <= low, packed).otherwise(F.expr(_NO_LONGS)).alias("_tg_p"))
    seen = F.transform(F.filter("_tg_p", lambda x, i: same("_tg_p", i, lambda y: F.shiftright(y, _POS))), lambda x: x.bitwiseAND(F.lit(low)).cast("int"))
    every = F.transform("_tg_g", lambda x, i: i)
    step = step.select(*base, "_tg_g", F.when(F.size("_tg_g") <= low, seen).otherwise(every).alias("_tg_c"))
    step = step.select(*base, F.array_sort(F.transform("_tg_c", lambda i: F.struct(at("_tg_g", i).alias("h"), i.alias("i")))).alias("_tg_s"))
    repeats = F.array_sort(F.transform(F.filter("_tg_s", lambda x, i: same("_tg_s", i, lambda y: y["h"])), lambda x: x["i"]))
    step = step.select(*base, repeats.alias("_tg_r"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate("_tg_r", start, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    return step.select(*base, covered.alias("n_repeat_words"))


def rule_columns() -> dict[str, Column]:
    """Which rules a measured document fails."""
    words = F.col("n_words")
    return {
        "short": words < 50,
        "repetitive": 100 * F.col("n_repeat_words") > 50 * words,
        "symbols": 10 * F.col("n_symbols") > 3 * words,
        "lines": 10 * F.col("n_dup_lines") > words,
        "lengths": (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 15 * words),
    }


def beta_prior(hosts: DataFrame, rule: str, most: float = 10_000.0) -> tuple[Column, Column]:
    """Beta parameters by moments of the hosts' failure rates, for a table with n and the failures of ``rule``.

    The mean is that of all documents; the strength mean * (1 - mean) / variance - 1 is kept within
    2 and ``most``, so that hosts of one document, or of equal rates, leave a proper prior.
    """
    mean = F.expr(f"coalesce(try_divide(sum({rule}), sum(n)), 0.0D)")
    spread = F.expr(f"coalesce(var_pop({rule} / n), 0.0D)")
    strength = F.greatest(F.lit(2.0), F.least(F.lit(most), F.when(spread > 0, mean * (1 - mean) / F.when(spread > 0, spread) - 1).otherwise(F.lit(most))))
    return mean, strength


def host_verdicts(measured: DataFrame, host: str = "source", worst: float = 0.3) -> DataFrame:
    """Per host: ``host``, n, the shrunk failure rate of each rule, and host_failed: one rate is over ``worst``.

    Rates are (failures + mean * strength) / (n + strength) under the empirical beta prior. Null is a
    host of its own. Counts are summed map-side, so a host with a third of all rows is one row a task.
    """
    rules = rule_columns()
    hosts = materialize(measured.groupBy(F.col(host)).agg(F.count("*").alias("n"), *[F.sum(c.cast("long")).alias(r) for r, c in rules.items()]), "hosts")
    named = [c.alias(f"{r}_{k}") for r in rules for c, k in zip(beta_prior(hosts, r), ("mean", "strength"), strict=True)]
    prior = hosts.agg(*named).first()
    rates = {r: (F.col(r) + prior[f"{r}_mean"] * prior[f"{r}_strength"]) / (F.col("n") + prior[f"{r}_strength"]) for r in rules}
    return hosts.select(host, "n", *[c.alias(f"{r}_rate") for r, c in rates.items()], (F.greatest(*rates.values()) > worst).alias("host_failed"))


def clear_failures() -> dict[str, Column]:
    """Which soft rules a measured document fails by half as much again as the rule allows."""
    words = F.col("n_words")
    return {
        "symbols": 20 * F.col("n_symbols") > 9 * words,
        "lines": 20 * F.col("n_dup_lines") > 3 * words,
        "lengths": (3 * F.col("word_chars") < 4 * words) | (2 * F.col("word_chars") > 45 * words),
    }


def with_verdicts(df: DataFrame, text: str = "text", host: str = "source", keep_text: bool = True, low: float = 0.02) -> DataFrame:
    """All columns of ``df`` (without ``text`` if not ``keep_text``) with the measures, ``base_failed`` and ``kept``.

    kept: the document passes both base rules and, in its host's light, every soft rule. One that
    clearly fails a soft rule (see ``clear_failures``) goes wherever it stands. One that just fails it
    goes if the host failed as a whole, or if the host's shrunk rate for that rule is over ``low``: it
    is then one of many there, and not an odd page of a clean host.
    Null texts count as empty (short, so not kept); a null host is a host of its own; repeated rows are
    judged alike; an empty table gives an empty result; columns of ``df`` with the names of added ones
    are replaced.
    """
    df = df.drop("base_failed", "kept")
    measured = with_measures(df, text)
    measured = materialize(measured if keep_text else measured.drop(text), "measured")
    rules, clear = rule_columns(), clear_failures()
    hosts = host_verdicts(measured, host)
    hosts = hosts.select(F.col(host).alias("_tg_host"), *[(F.col("host_failed") | (F.col(f"{r}_rate") > low)).alias(f"_tg_{r}") for r in SOFT])
    base, soft = rules["short"] | rules["repetitive"], F.lit(False)
    for r in SOFT:
        soft = soft | (rules[r] & (clear[r] | F.col(f"_tg_{r}")))
    joined = measured.join(hosts, measured[host].eqNullSafe(hosts["_tg_host"]))
    return joined.withColumns({"base_failed": base, "kept": ~base & ~soft}).drop("_tg_host", *[f"_tg_{r}" for r in SOFT])


def keep_quality(df: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``df`` that ``with_verdicts`` keeps, with its columns as they are, whatever their names.

    Null and blank texts go, as they are short; repeated rows stay or go together; an empty table stays empty.
    """
    judged = with_verdicts(held(df, text, host), "_tg_text", "_tg_host_of", keep_text=False)
    return judged.where("kept").select("_tg_own.*")


def op9_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document; the host is its source. The texts aren't stored again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = with_verdicts(docs, keep_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
s AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY rid),
g AS (SELECT rid, i, word || ' ' || lead(word, 1) OVER x || ' ' || lead(word, 2) OVER x AS win FROM w WINDOW x AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM g WHERE win IS NOT NULL) WHERE c > 1),
c AS (SELECT rid, count(*) AS n_repeat_words FROM (SELECT DISTINCT rid, i + k AS i FROM r, (VALUES (0), (1), (2)) AS v(k)) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
q AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT doc_id, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN s USING (rid) LEFT JOIN c USING (rid) LEFT JOIN q USING (rid)),
f AS (SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repetitive, 10 * n_symbols > 3 * n_words AS symbols,
  10 * n_dup_lines > n_words AS lines, word_chars < 2 * n_words OR word_chars > 15 * n_words AS lengths FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(short::INT)::DOUBLE AS f1, sum(repetitive::INT)::DOUBLE AS f2, sum(symbols::INT)::DOUBLE AS f3,
  sum(lines::INT)::DOUBLE AS f4, sum(lengths::INT)::DOUBLE AS f5 FROM f GROUP BY source),
u AS (SELECT source, n, rule, fails FROM h UNPIVOT (fails FOR rule IN (f1, f2, f3, f4, f5))),
p AS (SELECT rule, sum(fails) / sum(n) AS mean, var_pop(fails / n) AS spread FROM u GROUP BY rule),
k AS (SELECT rule, mean, greatest(2.0, least(10000.0, CASE WHEN spread > 0 THEN mean * (1 - mean) / spread - 1 ELSE 10000.0 END)) AS strength FROM p),
h2 AS (SELECT source, rule, (fails + mean * strength) / (n + strength) AS rate FROM u JOIN k USING (rule)),
b AS (SELECT source, bool_or(rate > 0.3) AS host_failed, max(rate) FILTER (rule = 'f3') > 0.02 AS many3, max(rate) FILTER (rule = 'f4') > 0.02 AS many4,
  max(rate) FILTER (rule = 'f5') > 0.02 AS many5 FROM h2 GROUP BY source)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, short OR repetitive AS base_failed,
  NOT (short OR repetitive)
  AND NOT (symbols AND (20 * n_symbols > 9 * n_words OR host_failed OR many3))
  AND NOT (lines AND (20 * n_dup_lines > 3 * n_words OR host_failed OR many4))
  AND NOT (lengths AND (3 * word_chars < 4 * n_words OR 2 * word_chars > 45 * n_words OR host_failed OR many5)) AS kept
FROM f JOIN b ON f.source IS NOT DISTINCT FROM b.source
"""
