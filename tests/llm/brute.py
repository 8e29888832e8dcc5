"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import xxhash

Span = tuple[int, int, str]
WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def fingerprint(text: str | None) -> int:
    w = WORD.findall(lower(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps: list[int], radius: int = 3) -> list[int]:
    """For each place the smallest place that links reach."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [find(x) for x in range(len(fps))]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str | None) -> list[Span]:
    """(start, end, kind) by start, then kind."""
    out = []
    for order, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), order, m.end(), kind))
    return [(a, b, k) for a, _, b, k in sorted(out)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def base_digest(text: str | None) -> str:
    return hashlib.sha256(joined(base_spans(text)).encode()).hexdigest()


def redacted(text: str | None, spans: list[Span]) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def measures(text: str | None) -> dict:
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def failures(m: dict) -> dict:
    w = m["n_words"]
    return {"short": w < 50, "repetitive": 100 * m["n_repeat_words"] > 50 * w, "symbols": 10 * m["n_symbols"] > 3 * w, "lines": 10 * m["n_dup_lines"] > w, "lengths": m["word_chars"] < 2 * w or m["word_chars"] > 15 * w}


def clear(m: dict) -> dict:
    w = m["n_words"]
    return {"symbols": 20 * m["n_symbols"] > 9 * w, "lines": 20 * m["n_dup_lines"] > 3 * w, "lengths": 3 * m["word_chars"] < 4 * w or 2 * m["word_chars"] > 45 * w}


def kept(rows: list[tuple[str | None, str | None]], worst: float = 0.3, low: float = 0.02) -> list[bool]:
    """rows: (text, host)."""
    m = [measures(t) for t, _ in rows]
    f = [failures(x) for x in m]
    hosts = {h: [x for x, (_, g) in zip(f, rows) if g == h] for _, h in rows}
    rate: dict = {}
    for rule in f[0] if f else ():
        rates = {h: sum(x[rule] for x in xs) / len(xs) for h, xs in hosts.items()}
        mean = sum(x[rule] for x in f) / len(f)
        centre = sum(rates.values()) / len(rates)
        spread = sum((r - centre) ** 2 for r in rates.values()) / len(rates)
        strength = max(2.0, min(10_000.0, mean * (1 - mean) / spread - 1 if spread > 0 else 10_000.0))
        for h, xs in hosts.items():
            rate[h, rule] = (sum(x[rule] for x in xs) + mean * strength) / (len(xs) + strength)
    failed = {h: any(rate[h, r] > worst for r in f[0]) for h in hosts}
    bad = lambda x, y, h: any(x[r] and (c or failed[h] or rate[h, r] > low) for r, c in clear(y).items())
    return [not (x["short"] or x["repetitive"]) and not bad(x, y, h) for x, y, (_, h) in zip(f, m, rows)]


def runs(text: str | None, width: int = 5) -> frozenset:
    w = WORD.findall(lower(text or ""))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def without_similar(rows: list[tuple[int, str | None]], percent: int = 80) -> list[int]:
    """rows: (key, text); the smallest keys of the groups that pairs at a Jaccard similarity of ``percent`` or more connect."""
    sets, root = [runs(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and root[a] != root[b]:
                root = [root[b] if r == root[a] else r for r in root]
    return sorted(min(rows[i][0] for i, r in enumerate(root) if r == g) for g in set(root))


def deduped_lines(rows: list[tuple[int | None, str | None, str | None]], min_sites: int = 3, short_sites: int = 10) -> list[tuple[str | None, int, int]]:
    """rows: (key, text, site); gives (text, lines, removed)."""
    cut = lambda x: x.strip(" \t\n\r\x0b\x0c")
    sites: dict[str, set] = {}
    keeper: dict[str, int] = {}
    for k, t, s in rows:
        for x in (t or "").split("\n") if t is not None else []:
            if c := cut(x):
                sites.setdefault(c, set()).add(s)
                if k is not None:
                    keeper[c] = min(keeper.get(c, k), k)
    gone = {c for c, s in sites.items() if len(s) >= (short_sites if len(WORD.findall(c)) < 5 else min_sites)}
    out = []
    for k, t, _ in rows:
        if t is None:
            out.append((None, 0, 0))
            continue
        lines, left, seen = t.split("\n"), [], set()
        for x in lines:
            c = cut(x)
            first = c not in seen
            seen.add(c)
            if c not in gone or (keeper.get(c) == k and first):
                left.append(x)
        out.append(("\n".join(left), len(lines), len(lines) - len(left)))
    return out
