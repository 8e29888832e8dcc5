"""Text functions, Column to Column. Built-ins only, but for Unicode normal forms of texts that aren't ASCII."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workers import ready

_DASHES = "‐‑‒–—―−"
_BREAKS = "\t\r\n"
_PLAIN = r"^[\x20-\x7E\n\t]*+$"
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"  # what (?U)\s matches
STOP_WORDS = tuple(sorted("a an and are as be by com da das de do dos e em for from in is it na no o of on or os para por que sua seu ao that the this to um uma with".split()))


def _nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def _casefold(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else s.casefold())


def _bare(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s.casefold()) if not unicodedata.combining(c)))


def _beyond_ascii(x: Column, f: Callable, ascii_form: Callable[[Column], Column]) -> Column:
    ready()
    beyond = r"[^\x00-\x7F]"
    # Python gets nulls for ASCII texts, and gives them back
    told = F.pandas_udf(f, T.StringType())(once(x, lambda v: F.when(v.rlike(beyond), v)))
    return F.coalesce(told, once(x, lambda v: F.when(~v.rlike(beyond), ascii_form(v))))


def _plain_letters() -> tuple[str, str]:
    """Letters of Latin scripts with accents, and each one's folded form where that is one ASCII letter."""
    pairs = {}
    for c in map(chr, (*range(0xA0, 0x250), *range(0x1E00, 0x1F00))):
        bare = "".join(x for x in unicodedata.normalize("NFKD", c.casefold()) if not unicodedata.combining(x))
        if len(bare) == 1 and bare.isascii():
            pairs[c] = bare
    return "".join(pairs), "".join(pairs.values())


_ACCENTED, _BARE = _plain_letters()


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once a row, however often ``f`` uses it.

    Spark puts an expression where its name stands, so one that is used in many places, or in a lambda, runs for each.
    """
    return F.get(F.transform(F.array(value), f), F.lit(0))


def text_or_blank(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def strip(x: Column) -> Column:
    """White space of any kind off both ends."""
    return F.btrim(x, F.lit(_WHITE))


def clean_scalar(x: Column) -> Column:
    return strip(text_or_blank(x))


def normalize_unicode(x: Column, newlines: bool, ascii_only: bool = False) -> Column:
    """NFKC, unified line ends and dashes, no format or control characters but joiners; separators become spaces.

    With ``newlines`` line breaks and tabs stay, else they are spaces. ``ascii_only`` promises ASCII texts
    and leaves the Python step out.
    """
    given = text_or_blank(x)
    x = given if ascii_only else _beyond_ascii(given, _nfkc, lambda v: v)
    x = F.regexp_replace(x, r"\r\n?", "\n")
    x = F.translate(x, _DASHES, "-" * len(_DASHES))
    x = F.regexp_replace(x, r"[\p{Cf}&&[^‌‍]]", "")
    x = F.regexp_replace(x, r"[\p{Cc}&&[^\n\t]]", "")
    x = F.regexp_replace(x, r"[\p{Zl}\p{Zp}]", "\n" if newlines else " ")
    x = F.regexp_replace(x, r"\p{Zs}", " ")
    x = F.when(given.rlike(_PLAIN), given).otherwise(x)  # nothing to do for printable ASCII
    return x if newlines else F.translate(x, "\n\t", "  ")


def clean_text(x: Column, ascii_only: bool = False) -> Column:
    return strip(normalize_unicode(x, True, ascii_only))


def clean_token(x: Column, ascii_only: bool = False) -> Column:
    return F.trim(F.regexp_replace(normalize_unicode(x, False, ascii_only), r"(?U)\s+", " "))


def canonical_display(x: Column, ascii_only: bool = False) -> Column:
    x = F.regexp_replace(clean_token(x, ascii_only), r"(?U)\s*-\s*", "-")
    return F.regexp_replace(F.regexp_replace(x, r"\( ", "("), r" \)", ")")


def fold(x: Column, ascii_only: bool = False) -> Column:
    return F.lower(x) if ascii_only else _beyond_ascii(x, _casefold, F.lower)


def fingerprint(x: Column, ascii_only: bool = False) -> Column:
    """Case- and separator-insensitive form of a name."""
    full = F.trim(F.regexp_replace(fold(canonical_display(x, ascii_only), ascii_only), r"(?U)[\W_]+", " "))
    return F.when(x.rlike(_PLAIN), F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))).otherwise(full)


def header_name(x: str) -> str:
    """The snake-case form of a header, on the driver: runs of letters and digits between single underscores."""
    shown = (c for c in unicodedata.normalize("NFKC", x or "") if c in _BREAKS or unicodedata.category(c) not in ("Cc", "Cf"))
    return "_".join("".join(c if c.isalnum() else " " for c in shown).casefold().split())


def issue_number(x: Column, ascii_only: bool = False) -> Column:
    """15.0 is 15; anything else stays."""
    return F.regexp_replace(clean_token(x, ascii_only), r"^(\d+)\.0+$", "$1")


def label_number(x: Column) -> Column:
    """As the evaluation reads numbers: a trailing .0 goes from any text."""
    return F.regexp_replace(clean_scalar(x), r"\.0+$", "")


def split_multivalue(x: Column, ascii_only: bool = False) -> Column:
    """A JSON list, or parts between bars; cleaned, without blanks, first of equals kept in order."""
    token = clean_token(x, ascii_only)
    bars = F.split(token, r"\|")
    json = F.when(token.startswith("["), F.from_json(token, "array<string>"))
    parts = F.transform(F.coalesce(json, bars), lambda v: clean_token(v, True))
    return F.array_distinct(F.filter(parts, lambda v: v != ""))


def head_tail(x: Column, budget: int | Column) -> tuple[Column, Column]:
    """The text within ``budget`` characters, its head and tail around a note of what is left out; and whether it was cut."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    s = strip(text_or_blank(x))
    n = F.length(s)
    note = F.concat(F.lit("\n[... "), (n - budget).cast("string"), F.lit(" caracteres omitidos ...]\n"))
    usable = F.greatest(F.lit(1), budget - F.length(note))
    head = F.ceil(usable * 0.65).cast("int")
    tail = usable - head
    start = F.when(tail == 0, F.lit(1)).otherwise(n - tail + 1)
    both = F.concat(F.regexp_replace(F.substring(s, F.lit(1), head), r"(?U)\s+$", ""), note, F.regexp_replace(F.substring(s, start, n), r"(?U)^\s+", ""))
    return F.when(n <= budget, s).when(budget <= 80, F.substring(s, F.lit(1), budget)).otherwise(both), n > budget


def part_of(cell: Column, name: str) -> Column:
    """The part ``name: ...`` of a cell that several annotators share, up to the next named part; the cell if it has none."""
    other = r"(?:;\s*[\w-]+\s*:)"
    pattern = rf"(?is)(?:^|;\s*){name}\s*:\s*((?:(?!{other}).)*)"
    return F.when(cell.rlike(pattern), F.trim(F.regexp_extract(cell, pattern, 1))).otherwise(cell)


def terms(x: Column, ascii_only: bool = False, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Words for matching: camel case apart, folded, no accents, two letters or more, no stop words."""
    camel = lambda v: F.regexp_replace(v, "([a-z])([A-Z])", "$1 $2")
    given, beyond = text_or_blank(x), r"[^\x00-\x7F]"
    low = F.lower(camel(given))
    if not ascii_only:  # the usual accents go in the row itself; Python gets texts with others, and nulls for the rest
        ready()
        folded = F.translate(F.replace(camel(given), F.lit("\u00DF"), F.lit("ss")), _ACCENTED, _BARE)
        told = F.pandas_udf(_bare, T.StringType())(F.when(given.rlike(beyond), once(folded, lambda v: F.when(v.rlike(beyond), v))))
        low = F.coalesce(told, F.when(given.rlike(beyond), F.lower(folded)).otherwise(low))
    words = F.regexp_extract_all(low, F.lit("[a-z0-9]{2,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*stop))


def phrase_in(phrase: Column, text: Column) -> Column:
    """Whether the phrase stands in the text as whole words, in any case; a blank one never does."""
    phrase = strip(phrase)
    quoted = F.concat(F.lit(r"(?iU)(?<!\w)\Q"), F.replace(phrase, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))
    return (phrase != "") & F.regexp_like(text, quoted)


def literal_match(evidence: Column, text: Column) -> Column:
    """Whether the evidence is in the text as it stands, or once white space is collapsed in both."""
    spaced = lambda v: strip(F.regexp_replace(v, r"(?U)\s+", " "))
    there = F.contains(text, evidence) | F.contains(spaced(text), spaced(evidence))
    return F.coalesce((evidence != "") & (text != "") & there, F.lit(False))


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32))


def estimated_tokens(x: Column) -> Column:
    return F.ceil(F.length(x) / 4).cast("long")


def base_url(x: Column) -> Column:
    """A URL without trailing slashes and /v1; null unless http(s) without credentials."""
    x = F.regexp_replace(F.regexp_replace(strip(text_or_blank(x)), "/+$", ""), "/v1$", "")
    return F.when(x.rlike(r"^https?://[^/@]+(/[^@]*)?$"), x)


def quantization(path: Column) -> Column:
    """Quantisation tag of a model file's name, or blank."""
    return F.upper(F.regexp_extract(path, r"(?i)(?:^|[-_.])((?:i?q\d+(?:_[a-z0-9]+)*)|bf16|f16|f32)(?=[-_.]|$)", 1))


def percent(x: Column) -> Column:
    return F.when(x.isNull(), F.lit("n/a")).otherwise(F.concat(F.format_number(100 * x, 2), F.lit("%")))
