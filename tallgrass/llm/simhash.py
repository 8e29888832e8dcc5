"""SimHash near-duplicates, joined by meet-in-the-middle ball hashing."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, materialize, own_columns, ready

_STEP = 1 << 15


def fingerprint(raw: bytes | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a UTF-8 text: ASCII lower case, ``width``-word shingles with repeats, strict majority."""
    words = raw.lower().split() if raw else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    digest, n = xxhash.xxh64_digest, len(words) - width + 1
    votes = np.zeros(64, dtype=np.int64)
    first, last = starts[:n], ends[width - 1 :]
    for i in range(0, n, _STEP):
        part = b"".join([digest(joined[s:e], seed) for s, e in zip(first[i : i + _STEP].tolist(), last[i : i + _STEP].tolist(), strict=True)])
        votes += np.unpackbits(np.frombuffer(part, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """Add the fingerprint as a signed long; a null or blank text gives 0."""
    ready(df.sparkSession)
    return df.withColumn(out, F.pandas_udf(_fingerprints, "long")(F.col(text).cast("binary")))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _block_masks(radius: int) -> list[int]:
    """Masks that keep three of radius + 3 blocks: two fingerprints in the radius agree under one at least."""
    blocks = radius + 3
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) & ~((1 << a) - 1) for a, b in itertools.pairwise(cuts)]
    return [_signed(sum(p)) for p in itertools.combinations(parts, 3)]


def near_links(fps: DataFrame, fp: str = "fp") -> DataFrame:
    """Links (u, v) that join the distinct values of ``fp`` (long) exactly as all pairs at 3 or fewer differing bits do.

    Each fingerprint emits its ball of radius 1 (65 variants); one with an even bit count also emits
    the shell at radius 2 (2016 more). Two fingerprints at 1 or 2 bits meet in a variant that is at most
    1 from both; at 3 bits one of them is even and the other odd, and they meet 2 from the even one and
    1 from the odd one. Whatever meets a variant's radius-1 member is at most 3 bits from it, so each
    variant links its members to the smallest such member: links stay linear in the variants, however
    many fingerprints crowd together, and a variant has at most 2081 members. Links are verified by
    their bit count all the same. Null fingerprints have no links; repeated ones are one node; an empty
    table has none.

    Before that, fingerprints that agree with no other one under any of 20 masks of three blocks out of
    six can have no partner in the radius; counting keys finds them, and they emit nothing.
    """
    fps = fps.select(F.col(fp).alias("fp")).where("fp is not null").distinct()
    masks = F.array(*[F.lit(m).cast("long") for m in _block_masks(3)])
    keys = fps.select("fp", F.posexplode(masks).alias("t", "mask")).select("fp", "t", (F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
    shared = keys.groupBy("t", "key").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("t", "key")
    active = materialize(keys.join(shared, ["t", "key"]).select("fp").distinct(), "active")

    ones = [1 << i for i in range(64)]
    twos = [a | b for a, b in itertools.combinations(ones, 2)]
    near = F.array(*[F.lit(_signed(x)).cast("long") for x in [0, *ones]])
    far = F.array(*[F.lit(_signed(x)).cast("long") for x in twos])
    odd = F.bit_count("fp").bitwiseAND(F.lit(1)) == 1
    balls = active.select("fp", F.lit(True).alias("near"), F.explode(near).alias("x")).unionByName(active.where(~odd).select("fp", F.lit(False).alias("near"), F.explode(far).alias("x")))
    met = balls.select("fp", "near", F.col("fp").bitwiseXOR(F.col("x")).alias("variant"))
    rep = F.min(F.when(F.col("near"), F.col("fp"))).over(Window.partitionBy("variant"))
    links = met.withColumn("rep", rep).where("rep is not null and rep <> fp").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("rep"))) <= 3)
    return links.select(F.col("fp").alias("u"), F.col("rep").alias("v")).distinct()


def near_components(docs: DataFrame, key: str = "doc_id", fp: str = "fp") -> DataFrame:
    """Add ``component_id``: the smallest ``key`` that a row's fingerprint reaches over links of 3 bits or fewer.

    ``docs`` should be a stored table, as it is read twice. Equal fingerprints are one node. A null key
    counts for nothing: its row takes the smallest other key of the component, or null if there is none.
    """
    firsts = materialize(docs.groupBy(F.col(fp).alias("_tg_fp")).agg(F.min(key).alias("_tg_min")), "firsts")
    roots = materialize(components(near_links(firsts, "_tg_fp")), "roots")
    rooted = firsts.join(roots, firsts["_tg_fp"] == roots["node"], "left").select("_tg_fp", "_tg_min", F.coalesce("root", "_tg_fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("_tg_min").alias("component_id"))
    named = rooted.join(least, "root").select("_tg_fp", "component_id")
    docs = docs.drop("component_id")
    return docs.join(named, docs[fp] == named["_tg_fp"]).drop("_tg_fp")


def simhash_components(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: key, fp (signed long), component_id. Columns besides the two are left out.

    Null and blank texts have fingerprint 0, repeated rows stay, an empty table gives an empty result.
    """
    fps = materialize(with_fingerprint(df.select(F.col(key), F.col(text)), text).select(key, "fp"), "fps")
    return near_components(fps, key)


@dataclass(frozen=True)
class Codes:
    """Several short SimHash codes of a text's set of shingles: ``tables`` codes of ``bits`` bits each."""

    width: int
    percent: int
    bits: int
    tables: int

    @staticmethod
    def differing(percent: int) -> float:
        """Share of SimHash bits in which two sets of this Jaccard similarity differ (equal sizes)."""
        j = percent / 100
        return math.acos(min(1.0, 2 * j / (1 + j))) / math.pi

    @staticmethod
    def of(rows: int, width: int = 5, percent: int = 80, recall: float = 0.95) -> Codes:
        """Bits and tables for so many rows.

        A variant should hold other texts by chance in few cases only, so codes get 10 bits more than
        the rows need to be numbered. Two sets at ``percent`` meet in a table if their codes differ in 2
        bits at most; there are enough tables that all but 1 - ``recall`` of such pairs are that near in one.
        More similar pairs are so more surely.
        """
        bits = min(56, max(28, math.ceil(math.log2(max(rows, 2))) + 10))
        p = Codes.differing(percent)
        meets = sum(math.comb(bits, i) * p**i * (1 - p) ** (bits - i) for i in range(3))
        return Codes(width, percent, bits, math.ceil(math.log(1 - recall) / math.log(1 - meets)))

    @property
    def most_bits(self) -> int:
        """Bits over all tables in which no more than one in 10^7 pairs at ``percent`` differ."""
        n, p = self.bits * self.tables, self.differing(self.percent)
        return math.ceil(n * p + 5.2 * math.sqrt(n * p * (1 - p)))


def shingles(raw: bytes | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """Distinct hashes (sorted longs) of a text's runs of ``width`` words in ASCII lower case; a shorter text is one run."""
    words = raw.lower().split() if raw else []
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], dtype=np.uint64).view(np.int64)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts, n = np.append(0, ends[:-1] + 1).tolist(), len(words) - width + 1
    return np.unique(np.frombuffer(b"".join([digest(joined[s:e], seed) for s, e in zip(starts[:n], ends[width - 1 :].tolist(), strict=True)]), dtype=">i8").astype(np.int64))


def _mixed(x: np.ndarray, word: int) -> np.ndarray:
    """The ``word``-th derived hash of each hash (the finaliser of SplitMix64)."""
    z = x + np.uint64((0x9E3779B97F4A7C15 * (word + 1)) & ((1 << 64) - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def simhash_codes(x: np.ndarray, c: Codes) -> list[int]:
    """The codes of a set of shingles, each with its table's number above its bits."""
    words = -(-c.bits * c.tables // 64)
    votes, rows = np.zeros(words * 64, dtype=np.int64), 255
    for i in range(0, len(x), _STEP):
        part = x[i : i + _STEP].view(np.uint64)
        bits = np.unpackbits(np.stack([_mixed(part, w) for w in range(words)], axis=1).view(np.uint8), axis=1)
        whole = len(bits) // rows * rows
        votes += bits[:whole].reshape(-1, rows, words * 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        votes += bits[whole:].sum(axis=0, dtype=np.uint8)
    ones = (votes * 2 > len(x))[: c.bits * c.tables].reshape(c.tables, c.bits)
    values = ones @ (np.int64(1) << np.arange(c.bits, dtype=np.int64))
    return ((np.arange(c.tables, dtype=np.int64) << c.bits) | values).tolist()


def _sketches(c: Codes):
    """Per text: ``told``, the identity of its set of shingles, and its codes."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingles(t, c.width) for t in texts]
            yield pd.DataFrame({"told": [xxhash.xxh3_128_digest(x.tobytes()) for x in sets], "codes": [simhash_codes(x, c) for x in sets]})

    return F.pandas_udf(run, "told binary, codes array<bigint>")


def _sets(width: int):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingles(t, width) for t in texts])

    return F.pandas_udf(run, "array<bigint>")


def rare_first(x: np.ndarray, common: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The hashes of a set in an order that is the same in all sets: by hash, the ``common`` (sorted) ones last, by ``place``."""
    if not len(common):
        return x
    at = np.minimum(np.searchsorted(common, x), len(common) - 1)
    hit = common[at] == x
    return np.concatenate([x[~hit], x[hit][np.argsort(place[at[hit]], kind="stable")]])


def bitmap(x: np.ndarray) -> np.ndarray:
    """Longs whose bits are set where a hash of the set ends in the bit's number; a power of two of bits, 1,024 and the set's size at least."""
    bits = max(1024, 1 << max(len(x) - 1, 0).bit_length())
    out = np.zeros(bits, dtype=np.uint8)
    out[x & (bits - 1)] = 1
    return np.packbits(out).view(np.int64)


def _prefixes(width: int, percent: int, common: np.ndarray, place: np.ndarray):
    """Per text: ``n``, the size of its set, its ``bits``, and ``x``, its first hashes, one of which any set at ``percent`` has too."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingles(t, width) for t in texts]
            firsts = [rare_first(x, common, place)[: len(x) - -(-percent * len(x) // 100) + 1] for x in sets]
            yield pd.DataFrame({"n": [len(x) for x in sets], "bits": [bitmap(x) for x in sets], "x": firsts})

    return F.pandas_udf(run, "n int, bits array<bigint>, x array<bigint>")


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """A stored table, broadcast if it has few enough rows."""
    return F.broadcast(df) if df.count() <= rows else df


def code_pairs(nodes: DataFrame, c: Codes) -> DataFrame:
    """Pairs (u < v) of stored ``nodes`` (node, codes) that share a code, linear in the codes, those far apart left out.

    Nodes with one code are linked to the smallest of them, and to one that the hash of node and code
    picks, another one in each table; both are minima that are summed map-side, so a code that a third of
    all nodes have is no one task's group. These are no more than the pairs that are cheap to find, which
    join most of a large group before ``prefix_pairs`` looks for all others. Pairs whose codes together
    differ in more than ``most_bits`` are chance meetings and go.
    """
    codes = nodes.select("node", F.explode("codes").alias("code"))
    reps = materialize(codes.groupBy("code").agg(F.min("node").alias("low"), F.min_by("node", F.xxhash64("node", "code")).alias("rep"), F.count("*").alias("many")).where("many > 1"), "codes")
    alike = codes.join(reps.select("code", F.array_distinct(F.array("low", "rep")).alias("r")), "code").select("node", F.explode("r").alias("r")).where("node <> r")
    pairs = materialize(alike.select(F.least("node", "r").alias("u"), F.greatest("node", "r").alias("v")).distinct(), "met")
    small = _bounded(nodes.select("node", "codes"), 200_000)
    a, b = (small.select(F.col("node").alias(k), F.col("codes").alias(f"c_{k}")) for k in "uv")
    apart = F.aggregate(F.zip_with("c_u", "c_v", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return pairs.join(a, "u").join(b, "v").where(apart <= c.most_bits).select("u", "v")


def _common(texts: DataFrame, width: int, nodes: int, least: int = 4, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) that many sets of a sample of ``texts`` (node, raw) hold, and the place of each by its count.

    The sample is a sixteenth of the sets, and 20,000 or all of them if that is more; at most ``most``
    hashes are kept. They only order the sets, and any one order finds all pairs: what the sample misses
    costs time and loses nothing.
    """
    share = min(1.0, max(1 / 16, 20_000 / max(nodes, 1)))
    sample = texts.where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < int(share * (1 << 20)))
    counts = sample.select(F.explode(_sets(width)("raw")).alias("tok")).groupBy("tok").count().where(F.col("count") >= least)
    top = counts.orderBy(F.desc("count"), "tok").limit(most).toPandas().sort_values(["count", "tok"])
    tok, place = top["tok"].to_numpy(np.int64), np.arange(len(top))
    by = np.argsort(tok)
    return tok[by], place[by]


def prefix_pairs(prefixes: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """All pairs (u < v) of stored ``prefixes`` (node, n, bits, x) of different ``roots`` (node, root) that may be at ``percent``.

    Two sets of sizes n and m at that similarity share percent * (n + m) / (100 + percent) hashes or more,
    so the first that they share, in the common order, is in both prefixes and leaves as many hashes from
    its place on in either set. Each bit that only one of them has stands for a hash at least that the
    other lacks, so bits rule out most pairs that share little besides. A hash that brings no two roots together counts for nothing; one that does
    pairs its nodes by pairs of roots, so the nodes of one root are never paired among themselves. Nothing
    is capped: a hash that is in the prefixes of many roots makes all their pairs.
    """
    rooted = prefixes.join(_bounded(roots, 2_000_000), "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"), F.posexplode("x").alias("at", "tok"))
    across = materialize(rooted.groupBy("tok").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("tok"), "across")
    entries = materialize(rooted.join(_bounded(across, 2_000_000), "tok").select("tok", "root", "node", "n", (F.col("n") - F.col("at")).alias("rest")), "entries")
    groups = materialize(entries.select("tok", "root").distinct(), "groups")
    met = groups.select("tok", F.col("root").alias("root_u")).join(groups.select("tok", F.col("root").alias("root_v")), "tok").where("root_u < root_v")
    for k in "uv":
        met = met.join(entries.select("tok", *[F.col(x).alias(f"{x}_{k}") for x in ("root", "node", "n", "rest")]), ["tok", f"root_{k}"])
    met = met.where((100 + percent) * F.least("rest_u", "rest_v").cast("long") >= percent * (F.col("n_u").cast("long") + F.col("n_v")))
    pairs = materialize(met.select(F.least("node_u", "node_v").alias("u"), F.greatest("node_u", "node_v").alias("v")).distinct(), "met")
    members = materialize(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "members")
    known = prefixes.select("node", "n", "bits").join(_bounded(members, 2_000_000), "node", "left_semi")
    a, b = (known.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"b_{k}")) for k in "uv")

    def shared(k: str, other: str) -> Column:
        lacking = F.zip_with(f"b_{k}", f"b_{other}", lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))))
        return F.col(f"n_{k}").cast("long") - F.aggregate(lacking, F.lit(0), lambda s, x: s + x)

    enough = (100 + percent) * F.least(shared("u", "v"), shared("v", "u")) >= percent * (F.col("n_u").cast("long") + F.col("n_v"))
    return pairs.join(a, "u").join(b, "v").where((F.size("b_u") != F.size("b_v")) | enough).select("u", "v")


def _verified(texts: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of stored ``pairs`` (u, v) those whose whole sets are at ``percent`` or more, stored."""
    members = materialize(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "members")
    full = materialize(texts.join(_bounded(members, 2_000_000), "node", "left_semi").select("node", _sets(width)("raw").alias("x")), "shingles")
    a, b = (full.select(F.col("node").alias(k), F.col("x").alias(f"x_{k}")) for k in "uv")
    both = F.size(F.array_intersect("x_u", "x_v"))
    return materialize(pairs.join(a, "u").join(b, "v").where(100 * both >= percent * (F.size("x_u") + F.size("x_v") - both)).select("u", "v"), "links")


def similar_links(stored: DataFrame, text: str = "text", width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Classes of equal shingle sets (_tg_row, node) of a stored table with _tg_row, and verified links (u, v) of nodes.

    The links join the nodes exactly as all pairs at a Jaccard similarity of ``percent`` or more of the
    sets of distinct ``width``-word runs do. Some are found by equal SimHash codes; what those leave in
    different components is searched for by prefixes, which miss no pair. Each is verified on whole sets.
    """
    ready(stored.sparkSession)
    c = Codes.of(stored.count(), width, percent)
    raw = F.col(text).cast("binary")
    sets = materialize(stored.select("_tg_row", _sketches(c)(raw).alias("s")).select("_tg_row", "s.*"), "sketches")
    nodes = materialize(sets.groupBy("told").agg(F.min("_tg_row").alias("node"), F.first("codes").alias("codes")), "nodes")
    classes = materialize(sets.join(nodes.select("told", "node"), "told").select("_tg_row", "node"), "classes")
    copies = materialize(classes.where("_tg_row <> node").select("_tg_row"), "copies")
    texts = stored.join(_bounded(copies, 2_000_000), "_tg_row", "left_anti").select(F.col("_tg_row").alias("node"), raw.alias("raw"))
    near = _verified(texts, materialize(code_pairs(nodes, c), "pairs"), width, percent)
    roots = materialize(components(near), "roots")
    prefixes = materialize(texts.select("node", _prefixes(width, percent, *_common(texts, width, nodes.count()))("raw").alias("s")).select("node", "s.*"), "prefixes")
    rest = _verified(texts, materialize(prefix_pairs(prefixes, roots, percent), "pairs"), width, percent)
    return classes, near.unionByName(rest)


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Keep one row of each group that verified pairs at a Jaccard similarity of ``percent`` or more connect.

    The row of the smallest key stays, and of rows with that key the one first in the table. Null and
    blank texts are equal to each other; a text of fewer than ``width`` words is one run; null keys come
    last, and rows without a key are told apart by their texts like any others; repeated rows leave one;
    an empty table stays empty. All columns stay, whatever their names.
    """
    own = F.struct(*own_columns(df)).alias("_tg_own")
    stored = materialize(df.select(F.monotonically_increasing_id().alias("_tg_row"), own), "texts")  # each column once
    part = lambda c, name: F.col("_tg_own").getField(c).alias(name)
    classes, links = similar_links(stored.select("_tg_row", part(text, "_tg_text")), "_tg_text", width, percent)
    roots = materialize(components(links), "roots")
    rooted = classes.join(roots, "node", "left").select("_tg_row", F.coalesce("root", "node").alias("root"))
    rooted = rooted.join(stored.select("_tg_row", part(key, "_tg_key")), "_tg_row")
    order = F.struct(F.col("_tg_key").isNull(), F.col("_tg_key"), F.col("_tg_row"))
    rooted = materialize(rooted.select("root", "_tg_row", order.alias("o")), "rooted")
    first = rooted.groupBy("root").agg(F.min("o").alias("o")).select(F.col("o._tg_row").alias("_tg_row"))
    gone = materialize(rooted.select("_tg_row").join(first, "_tg_row", "left_anti"), "gone")
    return stored.join(_bounded(gone, 2_000_000), "_tg_row", "left_anti").select("_tg_own.*")


def op5_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
