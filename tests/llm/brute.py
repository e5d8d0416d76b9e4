"""Plain-Python versions of what the operators promise, written for clarity."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


# --- quality rules --------------------------------------------------------------


def base_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    ws = words(text)
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if words(x) and x in lines[:i])
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    often = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    failed = len(ws) < 50 or 100 * len(inside) > 50 * len(ws)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(ws), sum(map(len, ws)), symbols, dup, len(inside), failed


# --- SimHash --------------------------------------------------------------------


def simhash(text, k=4):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = words(lower)
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=4):
    """The smallest id reachable for each of ``{id: fingerprint}``."""
    parent = {f: f for f in prints.values()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = sorted(parent)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    least = {}
    for d, f in prints.items():
        root = find(f)
        least[root] = min(d, least.get(root, d))
    return {d: least[find(f)] for d, f in prints.items()}


# --- exact dedup ----------------------------------------------------------------


def exact_groups(rows):
    """{doc_id: (keep_id, group_size, sha256)} of ``[(doc_id, text)]``, ids unique."""
    groups = {}
    for d, t in rows:
        key = hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", t or "").encode()).hexdigest()
        groups.setdefault(key, []).append((-len(t or ""), d))
    return {d: (min(g)[1], len(g), key) for key, g in groups.items() for _, d in g}


# --- personal data --------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def base_spans(text):
    found = []
    for place, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if fits:
                found.append((m.start(), place, f"{kind}:{m.start()}:{m.end()}"))
    return [label for _, _, label in sorted(found)]
