"""Plain-Python versions of what the stages of the pipeline do, one row after another."""

import math
import re
from collections import Counter

from test_secrets import brute as base_secrets

from tarnwell.llm import quality_rules as qr
from tarnwell.llm import secrets

WORDS = re.compile("[^\x20\x09-\x0d]+")


def statistics(text):
    """The statistics of ``quality_rules.STATISTICS`` from their meaning, byte by byte."""
    b = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", b)
    n, w = len(b), len(words)
    letters = sum(chr(c).isalpha() and c < 128 for c in b)
    upper, marks, symbols = (sum(65 <= c <= 90 for c in b), sum(c in qr.MARKS for c in b), sum(c in qr.SYMBOLS for c in b))
    counts, lines = Counter(words), [x for x in b.split(b"\n") if x]
    both = qr.MARKS + qr.SYMBOLS
    return {
        "log_bytes": math.log1p(n), "log_words": math.log1p(w), "word_bytes": sum(map(len, words)) / max(w, 1), "upper_share": upper / max(letters, 1),
        "digit_share": sum(48 <= c <= 57 for c in b) / max(n, 1), "mark_share": marks / max(n, 1), "symbol_share": symbols / max(n, 1),
        "space_share": (n - sum(map(len, words))) / max(n, 1), "high_share": sum(c >= 128 for c in b) / max(n, 1), "stop_share": sum(c in b".!?" for c in b) / max(n, 1),
        "distinct_words": len(counts) / max(w, 1), "top_word_share": max(counts.values(), default=0) / max(w, 1),
        "repeat_share": sum(x == y for x, y in zip(words, words[1:], strict=False)) / max(w - 1, 1), "lines_per_word": b.count(b"\n") / max(w, 1),
        "distinct_lines": len(set(lines)) / max(len(lines), 1) if w else 0.0, "marked_words": sum(x[-1] in qr.SYMBOLS for x in words) / max(w, 1),
        "upper_words": sum(len(x) > 1 and 65 <= x[0] <= 90 and 65 <= x[1] <= 90 for x in words) / max(w, 1),
        "doubled_marks": sum(x == y and y in both for x, y in zip(b, b[1:], strict=False)) / max(w, 1),
    }


def score(model, text):
    """The rules of a fitted model on one text."""
    s = list(statistics(text).values())
    total = model.intercept
    for rule in model.rules:
        if all(s[k] > t if above else s[k] <= t for k, above, t in rule.terms):
            total += rule.weight
    return 1 / (1 + math.exp(-total))


def without_exact_copies(rows):
    """Of equal texts one row with the largest doc_id."""
    best = {}
    for r in rows:
        key = r["text"] or ""
        if key not in best or (r["doc_id"] is not None and (best[key]["doc_id"] is None or r["doc_id"] > best[key]["doc_id"])):
            best[key] = r
    return list(best.values())


def without_near_copies(rows, width=5, percent=80):
    """Of each component of linked shingle sets the smallest doc_id; rows without doc_id stay."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for r in rows:
        w = WORDS.findall((r["text"] or "").translate(lower))
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a]["doc_id"] is None or rows[b]["doc_id"] is None or not sets[a] or not sets[b]:
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[root(i)] = min(least.get(root(i), r["doc_id"]), r["doc_id"])
    return [r for i, r in enumerate(rows) if r["doc_id"] is None or r["doc_id"] == least[root(i)]]


def spans(text):
    """(start, end, kind) of all secrets in code points: the base kinds, and the further ones by ``re``."""
    text = text or ""
    kinds = [r.kind for r in secrets.BASE_RULES]
    out = [(a, k, b, kinds[k]) for a, k, b in base_secrets(text)]
    tail = re.compile(r"[A-Za-z0-9._~+/=-]+\Z")
    for k, rule in enumerate(secrets.MORE_RULES, start=len(kinds)):
        for m in re.finditer(rule.pattern, text, re.I if rule.either_case else 0):
            if len(tail.search(m[0])[0] if rule.counted == "tail" else m[0]) >= rule.least:
                out.append((m.start(), k, m.end(), rule.kind))
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


def redacted(text):
    """Every secret replaced by its kind; an overlapping one that begins later is replaced only where it sticks out."""
    if text is None:
        return None
    parts, done = [], 0
    for a, b, kind in spans(text):
        if b <= done:
            continue
        if a >= done:
            parts += [text[done:a], f"<{kind}>"]
        done = b
    return "".join([*parts, text[done:]])
