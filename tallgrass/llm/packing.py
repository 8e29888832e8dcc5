"""Packing of tokenised documents into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, ready

_TAIL = ".,!?;:"
_MOST = 1_000_000
_LONG = 64  # characters of a word that is kept
_PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]
_RUN = 1 << 20  # words whose ids are laid out at once
_loaded: dict[str, tuple] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of whole texts, word by word.

    The tokenizer cuts at white space and looks at nothing across it, so a text's ids are its words'
    ids in turn: a batch of texts is split and its distinct words are found outside Python, and only
    those are looked up. The tokenizer also cuts between letters and other signs and lower-cases, so a
    word of letters before full stops and the like is known by its parts; each worker keeps up to a
    million of them. Parts are encoded many at once: each is one pre-token, whose last id is told by
    its end-of-word mark.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts: dict[str, bytes] = {"": b""}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    @staticmethod
    def load(path: str) -> WordEncoder:
        if path not in _loaded:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            _loaded[path] = WordEncoder(path)
        return _loaded[path]

    def _one_by_one(self, words: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _pre_tokens(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words) or cuts[-1] != len(ids):
            return self._one_by_one(words)
        raw, at = ids.tobytes(), [0, *(cuts * 4).tolist()]
        return [raw[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]

    def _apart(self, parts: list[str], pre_tokens: bool) -> dict[str, bytes]:
        short, long = [p for p in parts if len(p) <= _LONG], [p for p in parts if len(p) > _LONG]
        return dict(zip(short, self._ids_of(short, pre_tokens), strict=True)) | dict(zip(long, self._one_by_one(long), strict=True))

    def _ids_of(self, parts: list[str], pre_tokens: bool) -> list[bytes]:
        known = self.parts
        if any(len(p) > _LONG for p in parts):  # long ones are encoded for this batch and not kept, so that what is kept is bounded in bytes too
            own = self._apart(parts, pre_tokens)
            return [own[p] for p in parts]
        if new := [p for p in parts if p not in known]:
            if pre_tokens:  # those in ASCII need no normalising and no mapping of bytes
                cut = self.tokenizer.model.tokenize
                for p in new:
                    if p.isascii():
                        ids = [t.id for t in cut(p)]
                        known[p] = _PACK[len(ids)](*ids) if len(ids) < 32 else struct.pack(f"<{len(ids)}I", *ids)
                new = [p for p in new if not p.isascii()]
                for i in range(0, len(new), 4096):
                    known.update(zip(new[i : i + 4096], self._pre_tokens(new[i : i + 4096]), strict=True))
            else:
                known.update(zip(new, self._one_by_one(new), strict=True))
        return [known[p] for p in parts]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words in a row, and how many each has."""
        if len(self.parts) > _MOST:
            self.parts = {"": b""}
        cores = pc.utf8_rtrim(words, characters=_TAIL)
        plain = pc.utf8_is_alpha(cores)
        tails = pc.struct_field(pc.extract_regex(words, f"(?P<t>[{_TAIL}]*)$"), "t")
        lower = pc.if_else(pc.string_is_ascii(cores), pc.ascii_lower(cores), cores)
        found: list[bytes] = []
        index = []
        for column, pre_tokens in ((pc.if_else(plain, lower, ""), True), (pc.if_else(plain, tails, ""), True), (pc.if_else(plain, "", words), False)):
            encoded = column.dictionary_encode()
            index.append(encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(found))
            found += self._ids_of(encoded.dictionary.to_pylist(), pre_tokens)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        at = np.stack(index, axis=1).ravel()
        return _spread(np.frombuffer(b"".join(found), dtype="<u4"), sizes, at), sizes[at].reshape(-1, 3).sum(axis=1)

    def encode_many(self, texts: pa.Array, end: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Texts in runs: the first one's place, the ids of all in a row, and where each begins and ends. Null texts are empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        split = pc.utf8_split_whitespace(texts)
        flat = split.flatten().dictionary_encode()
        vocabulary, sizes = self._words(flat.dictionary)
        at, ends = flat.indices.to_numpy(zero_copy_only=False), np.asarray(split.offsets).astype(np.int64)
        ends = ends - ends[0]
        odd = pc.match_substring_regex(texts, r"[\x1c-\x1f]").to_numpy(zero_copy_only=False)
        if end is not None:  # one more word, after each text
            vocabulary, sizes = np.append(vocabulary, np.uint32(end)), np.append(sizes, 1)
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + _RUN, side="right")) - 1)
            words, cuts = at[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
            if end is not None:
                words, cuts = np.insert(words, cuts[1:], len(sizes) - 1), cuts + np.arange(len(cuts))
            edges = np.append(0, np.cumsum(sizes[words]))[cuts]
            ids = _spread(vocabulary, sizes, words)
            if odd[first:last].any():
                tail = [] if end is None else [end]
                whole = [np.array(self.tokenizer.encode(texts[first + i].as_py(), add_special_tokens=False).ids + tail, dtype="<u4") if x else ids[edges[i] : edges[i + 1]] for i, x in enumerate(odd[first:last])]
                ids, edges = np.concatenate(whole), np.append(0, np.cumsum([len(x) for x in whole]))
            yield first, ids, edges
            first = last

    def encode(self, text: str) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit integers."""
        return b"".join(ids.tobytes() for _, ids, _ in self.encode_many(pa.array([text], pa.string())))


def _spread(values: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs of ``values``, of which run i has ``sizes[i]``, in the order of ``at``."""
    lengths = sizes[at]
    begins = (np.cumsum(sizes) - sizes)[at] - (np.cumsum(lengths) - lengths)
    return values[np.repeat(begins, lengths) + np.arange(lengths.sum())]


def cut_pieces(df: DataFrame, text: str = "text", capacity: int = 4096, end: int = 2, path: str | None = None, ids: bool = False) -> DataFrame:
    """One row per piece: the columns of ``df`` but the text, then start, length, ids_crc32, doc_tokens,
    and on demand the piece's ids (little-endian unsigned 32-bit integers).

    A document is cut only into full windows and one remainder, so a text of up to ``capacity`` ids is
    never torn. A null or empty text has one piece, its ``end`` id. Columns with these names are replaced.
    """
    ready(df.sparkSession)
    path = path or default_tokenizer()
    added = {"start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint"} | ({"ids": "binary"} if ids else {})
    own = [c for c in df.columns if c != text and c not in added]
    kinds = dict(df.dtypes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, step = WordEncoder.load(path), capacity * 4
        for batch in batches:
            for first, flat, edges in encoder.encode_many(batch.column("_tg_text"), end):
                rows, out = [], {c: [] for c in added}
                view = memoryview(np.ascontiguousarray(flat)).cast("B")
                for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                    for start in range(0, b - a, capacity):
                        part = view[4 * (a + start) : min(4 * (a + start) + step, 4 * b)]
                        rows.append(first + i)
                        out["start"].append(start)
                        out["length"].append(len(part) // 4)
                        out["ids_crc32"].append(zlib.crc32(part))
                        out["doc_tokens"].append(b - a)
                        if ids:
                            out["ids"].append(part.tobytes())
                kept = [batch.column(c).take(pa.array(rows, pa.int64())) for c in own]
                made = [pa.array(v, pa.binary() if c == "ids" else pa.int64()) for c, v in out.items()]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=[*own, *added])

    schema = ", ".join(f"`{c}` {k}" for c, k in [*((c, kinds[c]) for c in own), *added.items()])
    return df.select(*own, F.col(text).cast("string").alias("_tg_text")).mapInArrow(cut, schema)


def differencing(lengths: np.ndarray, windows: int) -> tuple[np.ndarray, int]:
    """Window of each length by Karmarkar-Karp, and the largest window's sum.

    Each length starts as a partial partition with one filled window. The two partitions with the
    largest imbalance merge, the fullest window of one onto the emptiest of the other, until one is left.
    """
    n = len(lengths)
    left, right = np.full(2 * n * 2, -1, dtype=np.int64), np.full(2 * n * 2, -1, dtype=np.int64)
    free, heap, parts = n, [], {}
    for i, x in enumerate(lengths.tolist()):
        sums, nodes = np.zeros(windows, dtype=np.int64), np.full(windows, -1, dtype=np.int64)
        sums[0], nodes[0] = x, i
        parts[i] = (sums, nodes)
        heap.append((-(x if windows > 1 else 0), i))
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        (sa, na), (sb, nb) = parts.pop(a), parts[b]
        sums, nb = sa + sb[::-1], nb[::-1]
        both = (na >= 0) & (nb >= 0)
        new = int(both.sum())
        if free + new > len(left):
            left, right = (np.append(x, np.full(len(x) + new, -1, dtype=np.int64)) for x in (left, right))
        left[free : free + new], right[free : free + new] = na[both], nb[both]
        nodes = np.maximum(na, nb)
        nodes[both] = np.arange(free, free + new)
        free += new
        order = np.argsort(-sums, kind="stable")
        parts[b] = (sums[order], nodes[order])
        heapq.heappush(heap, (-int(sums[order[0]] - sums[order[-1]]), b))
    sums, nodes = parts[heap[0][1]]
    window = np.empty(n, dtype=np.int64)
    for w, top in enumerate(nodes.tolist()):
        stack = [top] if top >= 0 else []
        while stack:
            x = stack.pop()
            if x < n:
                window[x] = w
            else:
                stack += [left[x], right[x]]
    return window, int(sums[0])


def balanced(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Windows of near-equal sums within ``capacity``: from the fewest that could hold all, one more as long as one overflows."""
    windows = max(1, -(-int(lengths.sum()) // capacity))
    while True:
        window, most = differencing(lengths, windows)
        if most <= capacity:
            return window
        windows += 1


def pack(pieces: DataFrame, capacity: int = 4096, group: int = 1024, length: str = "length") -> DataFrame:
    """Add sequence_id and offset (long) to stored ``pieces`` with a ``length`` of 1 to ``capacity``.

    Full pieces are windows of their own and take no part in what follows. The rest are dealt evenly
    into groups of about ``group`` rows by row, not by key, and each group is packed by differencing in
    one small task; a group costs one partly filled window's padding at most beyond what differencing
    leaves. Full windows have odd numbers, the others even ones. Repeated rows are packed like any
    others; an empty table gives an empty result; columns named sequence_id or offset are replaced.
    """
    ready(pieces.sparkSession)
    pieces = materialize(pieces.drop("sequence_id", "offset").withColumn("_tg_row", F.monotonically_increasing_id()), "pieces")
    full, rest = pieces.where(F.col(length) >= capacity), pieces.where(F.col(length) < capacity)
    groups = max(1, -(-rest.count() // group))
    light = rest.select("_tg_row", F.col(length).alias("_tg_length"), F.pmod(F.xxhash64("_tg_row"), F.lit(groups)).alias("_tg_group"))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_tg_length", "_tg_row"], ascending=[False, True])
        sizes = pdf["_tg_length"].to_numpy()
        _, window = np.unique(balanced(sizes, capacity), return_inverse=True)
        before = pd.Series(sizes).groupby(window).cumsum().to_numpy() - sizes
        return pd.DataFrame({"_tg_row": pdf["_tg_row"].to_numpy(), "sequence_id": 2 * (pdf["_tg_group"].to_numpy() * (1 << 24) + window), "offset": before})

    seats = light.groupBy("_tg_group").applyInPandas(place, "_tg_row long, sequence_id long, offset long")
    whole = full.withColumns({"sequence_id": 2 * F.col("_tg_row") + 1, "offset": F.lit(0).cast("long")})
    return rest.join(seats, "_tg_row").unionByName(whole).drop("_tg_row")


def op8_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 4096 ids: one row per piece."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(cut_pieces(docs)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
