"""Personal data in texts: base patterns, and further candidates judged by boosted trees. DataFrame functions only."""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_columns

#: In the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone")

# Each finds what the plain leftmost pattern finds, without quadratic restarts or deep recursion: a run's
# first place stands for all of it, as a later start in the run has the same rest ahead.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "phone": "+"}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: What the generators propose besides: keys and tokens that open an account.
ALL_KINDS = (*KINDS, "secret")
_GAP = r"[ \u00A0./\u2013-]"
_LOOSE = r"[\s\u00A0.\u2013_/-]"
_HEX = "[0-9A-Fa-f]{1,4}"

#: High-recall generators: kind, pattern, and a simpler pattern that stands in every text with a match.
#: Their spans may overlap; boosted trees choose.
GENERATORS = (
    ("phone", rf"(?<![0-9A-Za-z])\(?[0-9]{{2,5}}\)?(?:{_GAP}{{1,3}}[0-9]{{2,8}}){{1,5}}(?![0-9])", rf"[0-9]\)?{_GAP}{{1,3}}[0-9]"),
    ("phone", r"(?<![0-9])00[1-9][0-9 ().-]{7,18}[0-9](?![0-9])", r"00[1-9]"),
    ("phone", r"(?<![0-9])[0-9]{9,15}(?![0-9])", r"[0-9]{9}"),
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?(?i:\[at\]|\(at\)|\{at\}| at ) ?[A-Za-z0-9-]{2,63}(?: ?(?i:\[dot\]|\(dot\)|\{dot\}| dot |\.) ?[A-Za-z]{2,24}){1,3}", r"(?i)[\[({ ]at[\])} ]"),
    ("ip", rf"(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![0-9A-Za-z:])", r"[0-9A-Fa-f]:[0-9A-Fa-f]|::"),
    ("card", rf"(?<![0-9])[0-9](?:{_LOOSE}{{0,2}}[0-9]){{11,18}}(?![0-9])", rf"[0-9]{_LOOSE}{{0,2}}[0-9]"),
    ("secret", r"(?<![0-9A-Za-z+/_=-])[0-9A-Za-z+/_-]{20,200}={0,2}(?![0-9A-Za-z+/_=-])", r"[0-9A-Za-z+/_-]{20}"),
)
_SPAN = "cast(array() as array<struct<start: int, end: int, text: string, kind: int>>)"
_BLOCK = 64


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, y: a + y)


def _cut(text: Column, pattern: str, when: Column) -> Column:
    """Matches and the pieces between them, or two empty arrays."""
    none = F.expr("cast(array() as array<string>)")
    return F.struct(F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none).alias("m"), F.when(when, F.split(text, pattern, -1)).otherwise(none).alias("p"))


def _placed(df: DataFrame, cut: str, kind: int, out: str) -> DataFrame:
    """Turn a cut into spans (start, end in code points, text, kind). Prefix sums go by blocks, so many matches stay cheap."""
    keep = [F.col(c) for c in df.columns if c not in (cut, out)]
    steps = F.zip_with(F.slice(F.col(f"{cut}.p"), F.lit(1), F.size(f"{cut}.m")), F.col(f"{cut}.m"), lambda p, m: F.length(p) + F.length(m))
    first = F.transform(f"{cut}.p", F.length)
    df = df.select(*keep, F.col(f"{cut}.m").alias("_tg_m"), first.alias("_tg_p"), F.when(F.size(f"{cut}.m") > 0, steps).otherwise(F.expr("cast(array() as array<int>)")).alias("_tg_d"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_tg_d") - 1) / _BLOCK).cast("int")), lambda b: _sum(F.slice("_tg_d", b * _BLOCK + 1, F.lit(_BLOCK))))
    ahead = F.aggregate(blocks, F.array(F.lit(0)), lambda a, y: F.concat(a, F.array(F.element_at(a, -1) + y)))
    df = df.select(*keep, "_tg_m", "_tg_p", "_tg_d", F.when(F.size("_tg_d") > 0, ahead).alias("_tg_b"))

    def span(m: Column, i: Column) -> Column:
        block = F.floor(i / _BLOCK).cast("int")
        start = F.get(F.col("_tg_b"), block) + _sum(F.slice("_tg_d", block * _BLOCK + 1, i - block * _BLOCK)) + F.get(F.col("_tg_p"), i)
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("text"), F.lit(kind).alias("kind"))

    return df.select(*keep, F.when(F.size("_tg_m") > 0, F.transform("_tg_m", span)).otherwise(F.expr(_SPAN)).alias(out))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _luhn(x: Column) -> Column:
    """Whether a text of digits passes Luhn's check."""
    digit = lambda d, i: F.substring(d, i + 1, F.lit(1)).cast("int")
    value = lambda d, i: _let(digit(d, i) * (i % 2 + 1), lambda v: F.when(v > 9, v - 9).otherwise(v))
    return _let(F.reverse(x), lambda d: _sum(F.transform(F.sequence(F.lit(0), F.length(d) - 1), lambda i: value(d, i))) % 10 == 0)


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return _luhn(_digits(x))
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


def with_base_spans(df: DataFrame, text: str = "text", out: str = "base") -> DataFrame:
    """Add the base spans, array<struct<start, end, text, kind>> by start, then kind.

    Null counts as empty; repeated rows are treated alike; an empty table gives an empty result; a column
    named ``out`` is replaced. Kinds that start at one place are listed in the order of KINDS.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    own, parts = df.drop(out).columns, []
    for k, kind in enumerate(KINDS):
        when = F.contains(t, F.lit(_NEEDS[kind])) if kind in _NEEDS else t.rlike(r"[0-9]\.[0-9]" if kind == "ip" else "[0-9][ -]?[0-9]")
        df = _placed(df.withColumn("_tg_cut", _cut(t, BASE[kind], when)), "_tg_cut", k, f"_tg_{kind}")
        parts.append(f"_tg_{kind}")
    passing = lambda kind: lambda s: _valid(kind, s["text"])
    chosen = [F.filter(p, passing(kind)) for p, kind in zip(parts, KINDS, strict=True)]
    ordered = F.array_sort(F.transform(F.concat(*chosen), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["text"].alias("text"))))
    return df.select(*own, F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["kind"].alias("kind"))).alias(out))


FEATURES = (
    "generator", "digits", "length", "separators", "parens", "phone_cue", "other_cue", "glued_before", "glued_after", "distinct_digits", "mail_cue", "known_tld", "letters", "groups",
    "luhn", "card_cue", "secret_cue", "hexadecimal", "mixed", "leading", "longest", "doubled", "spaced",
)
_PHONE_CUE = r"(?i)(?:tel|phone|call|fax|mobil|cell|whatsapp|sms|ruf|appel|ll[a\u00E1]m|m\u00F3vil|portable|handy)[^0-9]{0,14}$"
_OTHER_CUE = r"(?i)(?:version|release|build|order|isbn|issn|ticket|invoice|ref|total|serial|code|page|sum|dated?|from|on|commit|hash|sha|md5|checksum|digest|build|uuid|mac|\bid|\bno|\bv|#|\$|\u20AC|=|:|x)[^0-9A-Za-z]{0,3}$"
_MAIL_CUE = r"(?i)(?:mail|contact|write|reach|schreib|crire|correo|address)[^@]{0,14}$"
_CARD_CUE = r"(?i)(?:card|visa|master|amex|credit|debit|karte|carte|tarjeta|pan\b|paid with|iban)[^0-9]{0,14}$"
_SECRET_CUE = r"(?i)(?:token|secret|passw(?:or)?d|pwd|api|key|auth|bearer|credential|clave|passwort|mot de passe)[^0-9A-Za-z]{0,6}(?:is )?[^0-9A-Za-z]{0,4}$"


def _literal(pattern: str) -> str:
    return f"r'{pattern}'"


def _features(text: str, generator: int) -> str:
    """SQL of a candidate's features, for a span ``s`` of the column ``text``. As one text it costs one call, not a thousand."""
    gone = lambda p: f"v.n - length(regexp_replace(v.x, {_literal(p)}, ''))"
    flag = lambda of, p: f"int(coalesce({of} RLIKE {_literal(p)}, false))"
    luhn = "aggregate(transform(sequence(0, length(v.d) - 1), i -> int(substring(v.r, i + 1, 1)) * (i % 2 + 1)), 0, (a, y) -> a + if(y > 9, y - 9, y)) % 10 = 0"
    values = (
        str(generator), "length(v.d)", "v.n", gone("[ ./\\u00A0\\u2013_-]"), gone(r"[()\[\]{}]"), flag("v.before", _PHONE_CUE), flag("v.before", _OTHER_CUE),
        flag("v.before", r"[0-9A-Za-z_./+:-]$"), flag("v.after", r"^(?:[0-9A-Za-z_/:%-]|[.,][0-9])"), " + ".join(f"int(contains(v.d, '{i}'))" for i in range(10)), flag("v.before", _MAIL_CUE),
        flag("v.x", r"(?i)(?:com|org|net|edu|gov|io|info|eu|de|fr|es|uk|example)$"), gone("[A-Za-z]"), "size(v.parts)",
        f"CASE WHEN length(v.d) BETWEEN 12 AND 19 THEN int({luhn}) ELSE 0 END", flag("v.before", _CARD_CUE), flag("v.before", _SECRET_CUE), flag("v.x", "^(?:[0-9a-f]+|[0-9A-F]+)$"),
        flag("v.x", "[0-9].*[A-Za-z]|[A-Za-z].*[0-9]"), flag("v.x", r"^\(?0"), "array_max(transform(v.parts, p -> length(p)))", "int(contains(v.x, '::'))", gone(r"\s"),
    )
    digits = "regexp_replace(s.text, '[^0-9]', '')"
    around = (
        f"struct(s.text AS x, substring({text}, greatest(s.start - 23, 1), least(s.start, 24)) AS before, substring({text}, s.end + 1, 2) AS after, "
        f"{digits} AS d, reverse({digits}) AS r, split(s.text, '[^0-9A-Za-z]+') AS parts, length(s.text) AS n)"
    )
    return f"get(transform(array({around}), v -> struct({', '.join(f'double({w}) AS {name}' for name, w in zip(FEATURES, values, strict=True))})), 0)"


_CANDIDATE = "array<struct<start: int, end: int, text: string, kind: int, f: struct<" + ", ".join(f"{n}: double" for n in FEATURES) + ">>>"


def with_candidates(df: DataFrame, text: str = "text", out: str = "candidates") -> DataFrame:
    """Add what the generators propose, with the features of each span's format and surroundings.

    Null and empty texts have none; repeated rows are treated alike; an empty table gives an empty
    result; a column named ``out`` is replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    own, parts = df.drop(out).columns, []
    for g, (kind, pattern, worth) in enumerate(GENERATORS):
        df = _placed(df.withColumn("_tg_cut", _cut(t, pattern, t.rlike(worth))), "_tg_cut", ALL_KINDS.index(kind), f"_tg_g{g}")
        parts.append(f"_tg_g{g}")
    full = [f"transform({p}, s -> struct(s.start AS start, s.end AS end, s.text AS text, s.kind AS kind, {_features('_tg_t', g)} AS f))" for g, p in enumerate(parts)]
    return df.withColumn("_tg_t", t).select(*own, F.expr(f"cast(concat({', '.join(full)}) AS {_CANDIDATE})").alias(out))


def luhn_completed(digits: str) -> str:
    """``digits`` with the last one set so that the whole passes Luhn's check."""
    total = sum(v - 9 if v > 9 else v for i, c in enumerate(reversed(digits[:-1])) for v in [int(c) * (2 - i % 2)])
    return digits[:-1] + str(-total % 10)


def labelled_texts(rows: int, seed: int) -> list[tuple[str, int, int, int]]:
    """Made-up sentences, each with the extent and kind of its personal datum, or -1, -1, -1 where its look-alike is none."""
    rng = random.Random(seed)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    pick = lambda *x: rng.choice(x)
    word = lambda: "".join(rng.choice("aeiourstlnmcdp" + rng.choice(["", "\u00E9\u00E4\u00F1"])) for _ in range(rng.randint(2, 9)))
    plain = lambda: "".join(rng.choice("aeiourstlnmcdp") for _ in range(rng.randint(3, 9)))
    words = lambda a, b: "".join(word() + pick(" ", " ", " ", ", ", ". ", "\n", " | ") for _ in range(rng.randint(a, b)))
    chars = lambda k, of: "".join(rng.choice(of) for _ in range(k))
    many = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    phone = lambda: pick("call ", "tel. ", "phone: ", "fax ", "mobile ", "ruf an: ", "telephone ", "sms to ", "whatsapp ", "t\u00E9l : ", "m\u00F3vil ", "handy: ")
    h16 = lambda: f"{rng.randrange(1, 65536):x}"
    grouped = lambda d, gap, sizes: gap.join(d[sum(sizes[:i]) : sum(sizes[: i + 1])] for i in range(len(sizes)))

    def card_digits(size: int = 16) -> str:
        head = pick("4", "51", "55", "2221", "6011") if size == 16 else "37"
        return luhn_completed(head + n(size - len(head)))

    def v6() -> str:
        left, right = rng.randint(1, 4), rng.randint(0, 3)
        return pick(":".join(h16() for _ in range(8)), pick("2001", "fe80", "fd00", h16()) + "".join(":" + h16() for _ in range(left - 1)) + "::" + ":".join(h16() for _ in range(right)))

    good = [
        lambda: (phone(), f"({n(3)}) {n(3)}-{n(4)}"),
        lambda: (pick(phone(), ""), f"({n(3)}) {n(3)}-{n(4)}"),
        lambda: (phone(), f"{n(3)}{pick('-', '.', ' ')}{n(3)}{pick('-', '.')}{n(4)}"),
        lambda: (pick("", phone()), f"00{rng.randint(1, 9)}{n(1)} {n(3)} {n(3)} {n(4)}"),
        lambda: (phone(), f"0{n(rng.randint(8, 10))}"),
        lambda: (phone(), grouped("0" + n(9), pick(" ", ".", "-", "\u00A0"), [2, 2, 2, 2, 2])),
        lambda: (phone(), grouped(pick("6", "7", "9") + n(8), " ", [3, 2, 2, 2])),
        lambda: (phone(), grouped(pick("6", "7", "9") + n(8), " ", [3, 3, 3])),
        lambda: (phone(), f"0{n(rng.randint(2, 3))}{pick(' / ', '/', ' - ', ' ')}{n(3)} {n(2)} {n(2)}"),
        lambda: (phone(), f"0{n(rng.randint(2, 4))}{pick(' / ', '/', '-')}{n(rng.randint(5, 8))}"),
        lambda: (pick("mail ", "contact ", "write to ", ""), f"{plain()}{pick('.', '_', '')}{plain()}{pick(' [at] ', ' (at) ', '[at]', '(at)', ' (AT) ', ' {at} ')}{plain()}{pick('.', ' [dot] ', '[dot]', ' (dot) ', ' (DOT) ')}{pick('com', 'org', 'net', 'de')}"),
        lambda: (pick("mail ", "email me: ", "contact: ", "write to "), f"{plain()} at {plain()} dot {pick('com', 'org', 'net', 'de')}"),
        lambda: (pick("host ", "from ", "", "ip ", "server "), v6()),
        lambda: (pick("card ", "visa: ", "credit card ", "carte ", "tarjeta ", "karte: ", "paid with ", ""), grouped(card_digits(), pick(".", "\u00A0", "\u2013", "  ", " - ", "\n", "\t", "_", "/"), [4, 4, 4, 4])),
        lambda: (pick("card ", "amex ", "credit card "), grouped(card_digits(15), pick(".", "\u00A0", "\u2013", "  "), [4, 6, 5])),
        lambda: (pick('token = "', "token: ", "api_key=", "secret: ", "api key ", 'password = "', "auth token ", "bearer ", 'secret_key = "'), pick(chars(40, "0123456789abcdef"), chars(32, "0123456789abcdef"), chars(rng.randint(24, 48), many), chars(rng.randint(22, 64), many + "-_"))),
        lambda: (pick('token = "', "token: ", "secret: ", "api_key="), pick("ghp_", "sk-", "AKIA", "xoxb-") + chars(rng.randint(24, 40), many)),
    ]
    bad = [
        lambda: (pick("version ", "release ", "v", "build "), f"{n(2)}.{n(3)}.{n(4)}"),
        lambda: (pick("order ", "isbn ", "ticket ", "ref ", "id: ", "#", "serial "), n(rng.randint(9, 19))),
        lambda: (pick("", "", "and ", "of "), n(rng.randint(9, 19))),
        lambda: (pick("", "", "and ", "number ", "in "), n(16)),
        lambda: (pick("total ", "$", "sum of ", "", "some "), f"{rng.randint(1, 999)} {n(3)} {n(3)}"),
        lambda: (pick("isbn ", "issn ", "code "), f"{n(3)}-{n(rng.randint(1, 3))}-{n(4)}"),
        lambda: (pick("isbn ", "", "book "), f"978-{n(1)}-{n(2)}-{n(6)}-{n(1)}"),
        lambda: (pick("dated ", "on ", "from ", ""), pick(f"20{n(2)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"{rng.randint(1, 28):02}.{rng.randint(1, 12):02}.20{n(2)}", f"{rng.randint(1, 28):02}/{rng.randint(1, 12):02}/19{n(2)}", f"20{n(2)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02} {rng.randint(0, 23):02}")),
        lambda: (pick("", "pages ", "years ", "from "), pick(f"{n(2)}-{n(2)}", f"19{n(2)}-20{n(2)}", f"{n(3)}-{n(3)}", f"{n(2)} {n(2)} {n(2)}", f"{n(3)} / {n(3)}")),
        lambda: (pick("", "the "), grouped(n(16), pick(" ", "."), [4, 4, 4, 4])),
        lambda: (pick("", "the ", "values "), grouped(n(12), pick(" ", ".", "-"), [4, 4, 4])),
        lambda: (words(1, 2), f"{word()} at {word()}. {word()}"),
        lambda: (words(1, 2), f"{word()} at {word()}.{word()}"),
        lambda: (pick("at ", "from ", "took "), f"{n(2)}:{n(2)}:{n(2)}:{n(2)}"),
        lambda: (pick("mac ", "hash "), ":".join(f"{rng.randrange(256):02x}" for _ in range(6))),
        lambda: (pick("call ", "use ", ""), f"{pick('abc', 'bad', 'cafe', 'fee', 'a')}::{pick('add', 'face', 'b', 'de')}"),
        lambda: (pick("path /", "url http://x/", "="), f"{n(3)}-{n(3)}-{n(4)}/{n(3)}"),
        lambda: (pick("commit ", "sha1 ", "md5: ", "hash ", "checksum ", "digest ", "", "file "), pick(chars(40, "0123456789abcdef"), chars(32, "0123456789abcdef"), chars(64, "0123456789abcdef"))),
        lambda: (pick("id ", "uuid ", ""), "-".join(chars(k, "0123456789abcdef") for k in (8, 4, 4, 4, 12))),
        lambda: (pick("", "see ", "the ", "path "), pick("".join(plain().title() for _ in range(4)) + "Something", "_".join(plain() for _ in range(5)), "/".join(plain() for _ in range(5)) + "/x", "-".join(plain() for _ in range(5)))),
        lambda: (pick("", "so ", "aa "), chars(rng.randint(20, 60), pick("a", "-", "_", "ab", "=-", "ACGT"))),
        lambda: (pick("key ", "token "), "".join(plain() for _ in range(4)) + "something"),
        lambda: (pick("card ", "visa: "), grouped(str(int(luhn_completed("4" + n(15))) ^ 1), pick(".", " ", "\u00A0"), [4, 4, 4, 4])),
        lambda: (pick("", "data ", "row "), " ".join(n(rng.randint(1, 3)) for _ in range(rng.randint(5, 10)))),
        lambda: (pick("", "data ", "row "), "\n".join(n(rng.randint(1, 4)) for _ in range(rng.randint(4, 8)))),
        lambda: (pick("at ", "near ", ""), f"{n(2)}.{n(rng.randint(4, 6))}, {n(1)}.{n(rng.randint(4, 6))}"),
    ]
    by_kind = {"phone": good[:10], "email": good[10:12], "ip": good[12:13], "card": good[13:15], "secret": good[15:]}
    out = []
    for i in range(rows):
        label = i % 2
        kind = rng.choice(("phone", "phone", *by_kind))
        cue, datum = rng.choice(by_kind[kind] if label else bad)()
        head = f"{words(1, 4)}{cue}"
        tail = pick(" ", " ", ". ", ", ", "\n", '" ' if cue.endswith('"') else " ")
        out.append((f"{head}{datum}{tail}{words(1, 4)}", *((len(head), len(head) + len(datum), ALL_KINDS.index(kind)) if label else (-1, -1, -1))))
    return out


@dataclass(frozen=True)
class Trees:
    """Boosted depth-two trees: (feature, cut, (feature, cut, value, value), (feature, cut, value, value)), with a
    logistic calibration (slope, shift) and one threshold per kind."""

    bias: float
    trees: tuple
    slope: float
    shift: float
    thresholds: tuple[float, ...]


def _split(codes: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, int]:
    """The feature and the place among its cuts with the largest gain over ``rows``; codes: the first cut that a value isn't over."""
    g, h, best = g[rows], h[rows], (-1.0, 0, 0)
    for f, own in enumerate(cuts):
        gs, hs = (np.bincount(codes[f][rows], weights=w, minlength=len(own) + 1).cumsum() for w in (g, h))
        gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1)
        c = int(gain.argmax())
        if gain[c] > best[0] + 1e-9:
            best = (float(gain[c]), f, c)
    return best[1:]


def boost(x: np.ndarray, y: np.ndarray, rounds: int, rate: float) -> tuple[float, tuple]:
    """Logistic gradient boosting with depth-two trees and Newton leaves."""
    cuts = [u[:: max(1, len(u) // 12)] for u in (np.unique(x[:, f]) for f in range(x.shape[1]))]
    codes = np.stack([np.searchsorted(own, x[:, f], side="left") for f, own in enumerate(cuts)])
    bias = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    margin, trees, every = np.full(len(y), bias), [], np.ones(len(y), dtype=bool)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        f, c = _split(codes, g, h, every, cuts)
        sides = []
        for rows in (codes[f] <= c, codes[f] > c):
            f2, c2 = _split(codes, g, h, rows, cuts)
            leaves = []
            for leaf in (rows & (codes[f2] <= c2), rows & (codes[f2] > c2)):
                v = round(float(rate * g[leaf].sum() / (h[leaf].sum() + 1)), 6)
                margin[leaf] += v
                leaves.append(v)
            sides.append((f2, float(cuts[f2][c2]), *leaves))
        trees.append((f, float(cuts[f][c]), *sides))
    return bias, tuple(trees)


def margins(model: tuple[float, tuple], x: np.ndarray) -> np.ndarray:
    bias, trees = model
    m = np.full(len(x), bias)
    for f, c, a, b in trees:
        for rows, (f2, c2, lo, hi) in ((x[:, f] <= c, a), (x[:, f] > c, b)):
            m += np.where(rows, np.where(x[:, f2] <= c2, lo, hi), 0)
    return m


def calibrate(margin: np.ndarray, y: np.ndarray, kind: np.ndarray, precision: float) -> tuple[float, float, tuple[float, ...]]:
    """Platt's slope and shift, and per kind the least probability from which on held-out precision is met (2: never)."""
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-(a * margin + b)))
        a += 0.1 * float(((y - p) * margin).mean())
        b += 0.1 * float((y - p).mean())
    p = 1 / (1 + np.exp(-(a * margin + b)))
    thresholds = []
    for k in range(len(ALL_KINDS)):
        own = kind == k
        cuts = [float(c) for c in np.unique(p[own]) if c >= 0.5 and y[own & (p >= c)].mean() >= precision]
        thresholds.append(round(min(cuts) - 1e-6, 6) if cuts else 2.0)
    return round(a, 6), round(b, 6), tuple(thresholds)


@lru_cache(maxsize=4)
def _fit(spark: SparkSession, rows: int, seed: int, rounds: int, rate: float, precision: float) -> Trees:
    sample = labelled_texts(rows, seed)
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(sample)], "id long, text string, a int, b int, k int")
    judged = F.filter("candidates", lambda s: _apart(s, F.col("base")))
    rows = with_candidates(with_base_spans(df)).select("id", "a", "b", "k", judged.alias("c")).orderBy("id").collect()
    got = [(r, c, c["f"]) for r in rows for c in sorted(r["c"], key=lambda c: (c["start"], c["end"], c["f"]["generator"]))]
    x = np.array([[f[n] for n in FEATURES] for _, _, f in got])
    y = np.array([float(r["a"] >= 0 and c["kind"] == r["k"] and c["start"] >= r["a"] - 1 and c["end"] <= r["b"] + 1 and c["end"] - c["start"] >= 0.8 * (r["b"] - r["a"])) for r, c, _ in got])
    kind, held = np.array([c["kind"] for _, c, _ in got]), np.array([r["id"] % 3 == 0 for r, _, _ in got])
    model = boost(x[~held], y[~held], rounds, rate)
    slope, shift, thresholds = calibrate(margins(model, x[held]), y[held], kind[held], precision)
    return Trees(model[0], model[1], slope, shift, thresholds)


def fit(spark: SparkSession, rows: int = 6000, seed: int = 11, rounds: int = 60, rate: float = 0.3, precision: float = 0.98) -> Trees:
    """Train on ``rows`` labelled sentences (the bound), two thirds for the trees and one for calibration.

    The features come from the same expressions as at scoring; the driver gets those of the sample only.
    Candidates that touch a base span are left out, as they are never judged.
    """
    return _fit(spark, rows, seed, rounds, rate, precision)


def probability(trees: Trees, f: str) -> str:
    """SQL of a candidate's calibrated probability from its features, a struct named ``f``."""
    at = lambda i, c: f"{f}.{FEATURES[i]} <= {c!r}D"
    side = lambda x: f"CASE WHEN {at(x[0], x[1])} THEN {x[2]!r}D ELSE {x[3]!r}D END"
    sums = [f"CASE WHEN {at(g, c)} THEN {side(a)} ELSE {side(b)} END" for g, c, a, b in trees.trees]
    return f"1 / (1 + exp(-(({' + '.join([f'{trees.bias!r}D', *sums])}) * {trees.slope!r}D + {trees.shift!r}D)))"


def _apart(s: Column, others: Column) -> Column:
    return ~F.exists(others, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]))


def with_spans(df: DataFrame, text: str = "text", model: Trees | None = None) -> DataFrame:
    """Add ``base`` and ``spans``, arrays of struct<start, end, text, kind> by start, then kind.

    spans holds every base span, and of the generators' candidates those over their kind's threshold
    that touch no base span, the more probable first where candidates overlap. Offsets are code points
    of the whole text; a null text has none; repeated rows are treated alike; columns named base or
    spans are replaced.
    """
    model = model or fit(df.sparkSession)
    own = [F.col(c) for c in df.drop("base", "spans").columns]
    df = with_candidates(with_base_spans(df.drop("base", "spans"), text), text, "_tg_all")
    scored = F.expr(f"transform(_tg_all, s -> struct(-({probability(model, 's.f')}) AS p, s.start AS start, -s.end AS e, s.end AS end, s.text AS text, s.kind AS kind))")
    df = df.select(*own, "base", F.when(F.size("_tg_all") > 0, scored).alias("_tg_scored"))
    thresholds = f"array({', '.join(f'{t!r}D' for t in model.thresholds)})"
    likely = F.expr(f"array_sort(filter(_tg_scored, s -> -s.p >= element_at({thresholds}, s.kind + 1) AND NOT exists(base, o -> o.start < s.end AND s.start < o.end)))")
    df = df.select(*own, "base", F.when(F.size("_tg_scored") > 0, likely).alias("_tg_likely"))
    bare = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["kind"].alias("kind"))
    added = F.aggregate("_tg_likely", F.expr(_SPAN), lambda a, s: F.when(_apart(s, a), F.concat(a, F.array(bare(s)))).otherwise(a))
    df = df.select(*own, "base", F.when(F.size("_tg_likely") > 0, added).otherwise(F.expr(_SPAN)).alias("_tg_added"))
    ordered = F.array_sort(F.transform(F.concat("base", "_tg_added"), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["text"].alias("text"))))
    return df.select(*own, "base", F.when(F.size("_tg_added") > 0, F.transform(ordered, bare)).otherwise(F.col("base")).alias("spans"))


def redact(df: DataFrame, text: str = "text", model: Trees | None = None) -> DataFrame:
    """``df`` with each span in ``text`` replaced by its kind in brackets, such as [EMAIL].

    Spans that overlap are replaced as one, under the kind that starts first. Texts without spans, and
    null texts, stay as they are, as do all other columns, whatever their names; repeated rows are
    treated alike; an empty table stays empty.
    """
    found = with_spans(df.select(F.struct(*own_columns(df)).alias("_tg_own"), df[text].alias("_tg_text")), "_tg_text", model)
    label = F.array(*[F.lit(f"[{k.upper()}]") for k in ALL_KINDS])
    t = F.col("_tg_text")
    start = F.struct(F.expr("cast(array() as array<string>)").alias("parts"), F.lit(0).alias("at"))

    def step(a: Column, s: Column) -> Column:
        piece = F.array(F.substring(t, a["at"] + 1, s["start"] - a["at"]), F.element_at(label, s["kind"] + 1))
        new = F.struct(F.concat(a["parts"], piece).alias("parts"), s["end"].alias("at"))
        return F.when(s["start"] >= a["at"], new).otherwise(F.struct(a["parts"].alias("parts"), F.greatest(a["at"], s["end"]).alias("at")))

    done = F.aggregate("spans", start, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(t, a["at"] + 1, F.length(t))))
    new = F.when(F.size("spans") > 0, done).otherwise(t)
    return found.select(*[(new if c == text else F.col("_tg_own").getField(c)).alias(c) for c in df.columns])


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, ALL_KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, base digest and all spans of every document."""
    found = with_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    of = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{n}") for k, n in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
