"""SentencePiece BPE models by the shortest path of a weighted transducer that is searched, not built: pieces and byte fallback."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready
from .packing import _spread

SPACE = "▁"
_TAIL = ".,!?;:"
_MOST = 600_000
_LONG = 64  # characters of a stretch that is kept
_RUN = 1 << 20
_BASE = -1
_loaded: dict[str, Transducer] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Transducer:
    """The shortest path that the composition normaliser * pieces * neighbours would have, found without building it.

    As a machine: the normaliser writes U+2581 for a space and puts one before the text. The pieces'
    transducer has an arc for each piece (weight 0) and, for a character that no piece covers, one arc
    that writes its bytes (weight 1). A BPE model's ids are no path of least piece scores; they are the
    one path on which no two neighbours would have been merged otherwise. So the third machine remembers
    the last piece and has an arc of weight 0 to each piece that may follow it, and of infinite weight to
    all others. In the tropical semiring the shortest path through the three is that path.

    None of the three is compiled into states and arcs, and no composed machine is stored: it would have
    an arc for each pair of pieces that may touch. The normaliser is a replacement of characters, the
    pieces' arcs are a dictionary, and the neighbours' arcs are computed from the pieces' own merges when
    first asked for. ``path`` is the dynamic programme over places in the text that relaxes those arcs.

    Only runs of several spaces, whose pieces all have one score, depend on the order of equal merges;
    stretches with such runs are merged step by step instead, outside the path search.
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        n, t = proto.normalizer_spec, proto.trainer_spec
        if t.model_type != 2 or not t.byte_fallback or n.precompiled_charsmap or not n.add_dummy_prefix or n.remove_extra_whitespaces:
            raise ValueError("only BPE models with byte fallback, a leading space and no further normalising")
        self.pieces = [p.piece for p in proto.pieces]
        normal = [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type == 1]
        self.id = {p: i for i, p, _ in normal}
        scores = {s: k for k, s in enumerate(sorted({s for _, _, s in normal}, reverse=True))}
        self.rank = {p: scores[s] for _, p, s in normal if len(p) > 1}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.split: dict[str, tuple[str, str]] = {}
        for p in self.rank:
            parts, last = self.merged(p)
            if len(parts) == 1 and last:
                self.split[p] = last
        self.arcs = {p: p for p in self.id if len(p) == 1} | {p: p for p in self.split}  # one object for each piece
        self.longest = max(map(len, self.id), default=1)
        self.cuts_tails = not any(c in _TAIL for p in self.rank for c in p if any(x.isalpha() for x in p))
        self.neighbours: dict[tuple[str, str], bool] = {}
        self.parts: dict[str, bytes] = {"": b""}
        raw = [b""] * len(self.pieces)
        for p, i in self.id.items():
            raw[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            raw[i] = bytes([b])
        self.raw, self.raw_sizes = np.frombuffer(b"".join(raw), dtype=np.uint8), np.array([len(x) for x in raw], dtype=np.int64)

    @staticmethod
    def load(path: str) -> Transducer:
        if path not in _loaded:
            _loaded[path] = Transducer(path)
        return _loaded[path]

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Pieces by merging step by step, best score first and leftmost among equals; and the last merge."""
        symbols, n, last = list(text), len(text), None
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, symbols[i] + symbols[i + 1]) for i in range(n - 1) if (r := self.rank.get(symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if not symbols[i] or j >= n or symbols[i] + symbols[j] != both:
                continue
            last = (symbols[i], symbols[j])
            symbols[i], symbols[j], after[i] = both, "", after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := self.rank.get(both + symbols[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, both + symbols[after[i]]))
            if (k := before[i]) >= 0 and (r := self.rank.get(symbols[k] + both)) is not None:
                heapq.heappush(heap, (r, k, symbols[k] + both))
        return [s for s in symbols if s], last

    def may_follow(self, a: str, b: str) -> bool:
        """Whether merging leaves ``a`` and then ``b``: going back through the merges that made the two, the
        parts that touch must never have been a pair that is merged before the next of those merges."""
        known = self.neighbours.get((a, b))
        if known is not None:
            return known
        rank, split, key, limit, good = self.rank, self.split, (a, b), 1 << 60, True
        while True:
            r = rank.get(a + b)
            if r is not None and r < limit:
                good = False
                break
            ra, rb = rank.get(a, _BASE), rank.get(b, _BASE)
            if ra == _BASE and rb == _BASE:
                break
            if ra > rb:
                limit, a = ra, split[a][1]
            else:
                limit, b = rb + 1, split[b][0]
        if len(self.neighbours) > _MOST // 2:
            self.neighbours.clear()
        self.neighbours[key] = good
        return good

    def path(self, text: str) -> list[int]:
        """Ids on the shortest path through the composed machine."""
        n, arcs, ids = len(text), self.arcs, self.id
        if SPACE + SPACE in text:
            return [i for p in self.merged(text)[0] for i in ([ids[p]] if p in ids else [self.byte[b] for b in p.encode()])]
        far = 1 << 60
        cost, last, come = [0] + [far] * n, [""] * (n + 1), [0] * (n + 1)
        follow = self.may_follow
        for i in range(1, n + 1):
            best = far
            for j in range(i - 1, max(-1, i - self.longest - 1), -1):
                piece = text[j:i]
                if cost[j] >= best:
                    continue
                if (known := arcs.get(piece)) is not None:
                    piece = known
                    if not last[j] or follow(last[j], piece):
                        best, last[i], come[i] = cost[j], piece, j
                elif j == i - 1 and piece not in ids:
                    best, last[i], come[i] = cost[j] + 1, "", j
            cost[i] = best
        out, i = [], n
        while i:
            piece = text[come[i] : i]
            out.append([ids[piece]] if last[i] else [self.byte[b] for b in piece.encode()])
            i = come[i]
        return [x for part in reversed(out) for x in part]

    def _ids_of(self, parts: list[str]) -> list[bytes]:
        known, own = self.parts, {}
        for p in parts:
            if p not in known:  # long ones are kept for this batch only, so that what is kept is bounded in bytes too
                (known if len(p) <= _LONG else own)[p] = np.array(self.path(p), dtype="<u4").tobytes()
        return [own[p] if p in own else known[p] for p in parts]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > _MOST:
            self.parts = {"": b""}
        cores = pc.utf8_rtrim(words, characters=_TAIL)
        cut = pc.match_substring_regex(cores, r"\p{L}$") if self.cuts_tails else pa.array([False] * len(words))
        tails = pc.struct_field(pc.extract_regex(words, f"(?P<t>[{_TAIL}]*)$"), "t")
        found: list[bytes] = []
        index = []
        for column in (pc.if_else(cut, cores, words), pc.if_else(cut, tails, "")):
            encoded = column.dictionary_encode()
            index.append(encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(found))
            found += self._ids_of(encoded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        at = np.stack(index, axis=1).ravel()
        return _spread(np.frombuffer(b"".join(found), dtype="<u4"), sizes, at), sizes[at].reshape(-1, 2).sum(axis=1)

    def encode_many(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Texts in runs: the first one's place, the ids of all in a row, and where each begins and ends.

        Neither a line break nor the place before a space is ever inside a piece, so stretches between
        them are encoded once for a batch.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        marked = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(SPACE, pc.replace_substring(texts, " ", SPACE), ""))
        marked = pc.replace_substring_regex(pc.replace_substring(marked, "\n", " \n "), f"({SPACE}+)", r" \1")
        split = pc.split_pattern(marked, " ")
        flat = split.flatten().dictionary_encode()
        vocabulary, sizes = self._words(flat.dictionary)
        at, ends = flat.indices.to_numpy(zero_copy_only=False), np.asarray(split.offsets).astype(np.int64)
        ends, first = ends - ends[0], 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + _RUN, side="right")) - 1)
            words, cuts = at[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
            yield first, _spread(vocabulary, sizes, words), np.append(0, np.cumsum(sizes[words]))[cuts]
            first = last

    def decode_many(self, ids: np.ndarray, edges: np.ndarray) -> list[bytes]:
        """The UTF-8 texts of runs of ids: pieces and bytes in a row, without the leading space."""
        at = ids.astype(np.int64)
        cuts = np.append(0, np.cumsum(self.raw_sizes[at]))[edges].tolist()
        data = _spread(self.raw, self.raw_sizes, at).tobytes()
        return [data[a + (data[a : a + 1] == b" ") : b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _schema(df: DataFrame, own: list[str], added: dict[str, str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {k}" for c, k in [*((c, kinds[c]) for c in own), *added.items()])


def encode_pieces(df: DataFrame, text: str = "text", model: str | None = None, out: str = "ids") -> DataFrame:
    """Add ``out``: the text's ids, array<int>. Null gives null, an empty text no ids; other columns stay."""
    ready(df.sparkSession)
    model, own = model or default_model(), [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer.load(model)
        for batch in batches:
            texts = batch.column("_tg_text")
            for first, ids, edges in machine.encode_many(texts):
                part = batch.slice(first, len(edges) - 1)
                mask = pc.is_null(part.column("_tg_text"))
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.astype(np.int32)))
                lists = pc.if_else(mask, pa.scalar(None, lists.type), lists)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in own], lists], names=[*own, out])

    return df.select(*own, F.col(text).cast("string").alias("_tg_text")).mapInArrow(run, _schema(df, own, {out: "array<int>"}))


def decode_pieces(df: DataFrame, ids: str = "ids", model: str | None = None, out: str = "decoded") -> DataFrame:
    """Add ``out``: the text of an array<int> of ids. Null gives null; bytes that are no UTF-8 become U+FFFD; ids of control pieces write nothing."""
    ready(df.sparkSession)
    model, own = model or default_model(), [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer.load(model)
        for batch in batches:
            lists = batch.column("_tg_ids")
            texts = [None if x is None else machine.decode_many(np.array(x, dtype=np.int64), np.array([0, len(x)]))[0].decode("utf-8", "replace") for x in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], pa.array(texts, pa.string())], names=[*own, out])

    return df.select(*own, F.col(ids).cast("array<int>").alias("_tg_ids")).mapInArrow(run, _schema(df, own, {out: "string"}))


def piece_digests(df: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """The columns of ``df`` but the text, then n_ids, n_bytes (ids of byte fallback), ids_crc32 (of little-endian
    unsigned 32-bit ids) and round_trip: whether decoding gives the text back. A null text is empty.

    A text with U+2581 itself comes back with spaces there, so its round_trip is false.
    """
    ready(df.sparkSession)
    model = model or default_model()
    added = {"n_ids": "bigint", "n_bytes": "bigint", "ids_crc32": "bigint", "round_trip": "boolean"}
    own = [c for c in df.columns if c != text and c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer.load(model)
        fallback = np.zeros(len(machine.pieces), dtype=np.int64)
        fallback[list(machine.byte.values())] = 1
        for batch in batches:
            texts = pc.fill_null(batch.column("_tg_text"), "")
            for first, ids, edges in machine.encode_many(texts):
                rows = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
                view = memoryview(np.ascontiguousarray(ids)).cast("B")
                counts = np.append(0, np.cumsum(fallback[ids.astype(np.int64)]))
                whole = texts.slice(first, len(rows)).cast(pa.binary()).to_pylist()
                values = [
                    pa.array(np.diff(edges)), pa.array(counts[edges[1:]] - counts[edges[:-1]]), pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in rows], pa.int64()),
                    pa.array([a == b for a, b in zip(machine.decode_many(ids, edges), whole, strict=True)], pa.bool_()),
                ]
                part = batch.slice(first, len(rows))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in own], *values], names=[*own, *added])

    return df.select(*own, F.col(text).cast("string").alias("_tg_text")).mapInArrow(run, _schema(df, own, added))


def op7_piece_wfst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return piece_digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
