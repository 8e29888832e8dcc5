"""Texts cut into passages, and the passages that fit a budget. Greedy and sequential within one text, so in Arrow UDFs."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS
from ..workers import ready

OMITTED = "\n[... omitted ...]\n"
_SPANS = "array<struct<start: int, end: int>>"
_STOP = frozenset(STOP_WORDS)


def word_set(text: str) -> set[str]:
    """The distinct terms of a text, as functions.text.terms has them."""
    text = unicodedata.normalize("NFKD", re.sub(r"([a-z])([A-Z])", r"\1 \2", text).casefold())
    found = re.findall("[a-z0-9]+", "".join(c for c in text if not unicodedata.combining(c)))
    return {w for w in found if len(w) > 1} - _STOP


def cut_spans(text: str, most: int, lines_first: bool = True) -> list[tuple[int, int]]:
    """Offsets of passages of up to ``most`` characters that together are the text.

    A passage ends behind a line break in its second half, else behind a space there (or behind the later
    of both, unless ``lines_first``), else where it is full.
    """
    spans, at, size = [], 0, len(text)
    while at < size:
        stop = min(size, at + most)
        if stop < size:
            half = at + most // 2
            line, space = text.rfind("\n", half, stop), text.rfind(" ", half, stop)
            place = (line if line >= 0 else space) if lines_first else max(line, space)
            stop = place + 1 if place >= 0 else stop
        spans.append((at, stop))
        at = stop
    return spans


class Passage(NamedTuple):
    index: int
    start: int
    end: int
    words: set[str]


class Overflow(ValueError):
    """A passage that must stay doesn't fit."""


def choose_spans(text: str, budget: int, query: str, most: int, edges: bool = False, required: Sequence[str] = ()) -> list[tuple[int, int]]:
    """The passages to keep within ``budget`` characters, merged where they touch.

    Those with required evidence come first, then first and last if ``edges``, then by the query's terms
    weighted by rarity among the passages; one that doesn't fit is skipped and the next one tried.
    """
    if budget < len(text):
        return _within(text, budget, query, most, edges, required) if budget > 0 else []
    return [(0, len(text))] if text else []


def _within(text: str, budget: int, query: str, most: int, edges: bool, required: Sequence[str]) -> list[tuple[int, int]]:
    parts = [Passage(i, a, b, word_set(text[a:b])) for i, (a, b) in enumerate(cut_spans(text, min(most, max(80, budget // 3))))]
    wanted = word_set(query)
    common = Counter(t for p in parts for t in p.words & wanted)
    must = [(at, at + len(e)) for e in required if e and (at := text.find(e)) >= 0]
    last = len(parts) - 1

    def held(p: Passage) -> bool:
        return any(p.start < y and x < p.end for x, y in must)

    def order(p: Passage) -> tuple:
        rarity = sum(math.log(1 + len(parts) / (1 + common[t])) for t in sorted(p.words & wanted))
        return not held(p), not (edges and p.index in (0, last)), -rarity / math.sqrt(max(1, len(p.words))), p.index

    kept: list[Passage] = []
    room = budget
    for p in sorted(parts, key=order):
        cost = p.end - p.start + (len(OMITTED) if kept else 0)
        if cost <= room:
            kept.append(p)
            room -= cost
        elif held(p):
            raise Overflow("required evidence doesn't fit the budget")
    out: list[tuple[int, int]] = []
    for p in sorted(kept, key=lambda p: p.index):
        touching = out and out[-1][1] == p.start
        out[-1:] = [(out[-1][0], p.end)] if touching else [*out[-1:], (p.start, p.end)]
    return out


def span_chunks(text: Column, most: int, lines_first: bool = True, keep_blank: bool = False) -> Column:
    """Array of (start, end). A null text has none; ``keep_blank`` gives a blank one a single empty passage."""
    ready()

    @F.pandas_udf(_SPANS)
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([[(0, 0)] if keep_blank and not (t or "").strip() else cut_spans(t or "", most, lines_first) for t in texts])

    return cut(text)


def select_context(df: DataFrame, body: str, comments: str, query: str, available: Column | int, most: int = 600, body_share: float = 0.75, required: str | None = None, out: str = "context") -> DataFrame:
    """Add ``out``: struct(body, comments, body_spans, comment_spans, omitted, error).

    The body gets ``body_share`` of the ``available`` characters if there are comments, the comments what
    is left; their query takes in the chosen body. ``required`` names an array of evidence that must stay
    where a text has it; if it can't, error says so and the texts are null.
    """
    ready(df.sparkSession)
    kind = f"body string, comments string, body_spans {_SPANS}, comment_spans {_SPANS}, omitted boolean, error string"

    @F.pandas_udf(kind)
    def choose(bodies: pd.Series, others: pd.Series, queries: pd.Series, room: pd.Series, evidence: pd.Series) -> pd.DataFrame:
        rows = []
        for b, c, q, n, e in zip(bodies, others, queries, room, evidence, strict=True):
            b, c, q, e = b or "", c or "", q or "", list(e) if e is not None else []
            try:
                first = choose_spans(b, min(len(b), int(n if not c else int(n * body_share))), q, most, True, e)
                chosen = OMITTED.join(b[x:y] for x, y in first)
                second = choose_spans(c, max(0, int(n) - len(chosen)), q + "\n" + chosen, most, False, e)
                told = OMITTED.join(c[x:y] for x, y in second)
                if any(x and (x in b or x in c) and x not in chosen and x not in told for x in e):
                    raise Overflow("required evidence is lost")
                cut = sum(y - x for x, y in first) < len(b) or sum(y - x for x, y in second) < len(c)
                rows.append((chosen, told, first, second, cut, None))
            except Overflow as x:
                rows.append((None, None, [], [], True, str(x)))
        return pd.DataFrame(rows, columns=["body", "comments", "body_spans", "comment_spans", "omitted", "error"])

    room = F.lit(available) if isinstance(available, int) else available
    return df.withColumn(out, choose(F.col(body), F.col(comments), F.col(query), room, F.col(required) if required else F.array().cast("array<string>")))
