"""Secret scans: all rules in one pass over the bytes of many texts, by deterministic automata of a few rules each (see ``automaton``)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.automaton import BREAK, Automaton, lengths, once, parse
from tarnwell.llm.common import text_column, worker_cache

#: Bytes that are scanned at once; one longer text is scanned whole.
SCAN_BYTES = 4 << 20
#: Rules in one automaton; the product of all eight has 12,533 states and takes 20 s to build, two have some 1,300 and take 2 s.
TOGETHER = 5


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` are found leftmost and without overlap; those with fewer than ``least`` characters are dropped.

    ``counted``: whether the whole match counts or only its closing repeat.
    """

    kind: str
    pattern: str
    least: int
    counted: str = "match"
    either_case: bool = False


#: The patterns and least lengths of the base kinds, in their order.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, "tail", True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)

#: Further kinds: JSON web tokens, tokens with a provider's prefix, private keys with both of their lines, bearer headers, addresses with a password.
MORE_RULES = (
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("provider", r"(gh[oprsu]_|github_pat_|glpat-|xox[abprs]-|[rs]k_live_|sk-proj-|sk-ant-|npm_|AIza)[A-Za-z0-9_-]+", 20),
    Rule("pem", r"-----BEGIN\x20[A-Z0-9\x20]*PRIVATE\x20KEY-----([A-Za-z0-9+/=:,.\x0A\x0D\x20\x5C]|-[A-Za-z0-9])+-----END\x20[A-Z0-9\x20]*PRIVATE\x20KEY-+", 1),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/=-]+", 20, "tail", True),
    Rule("url", r"[A-Za-z][A-Za-z0-9+.-]*://[A-Za-z0-9._%+-]*:[!-.0-?A-~]+@[A-Za-z0-9.-]+", 1),
)
ALL_RULES = BASE_RULES + MORE_RULES


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        trees = [parse(r.pattern, r.either_case) for r in rules]
        self.automata = [Automaton(trees[lo : lo + TOGETHER]) for lo in range(0, len(trees), TOGETHER)]
        self.automaton = self.automata[0]
        self.fixed = []
        for tree in trees:
            low, high = lengths(once(tree))
            self.fixed.append(low if low == high else None)

    def matches(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text the (start, number of the rule, end) in bytes, sorted."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        lo = 0
        while lo < len(texts):
            hi, total = lo, 0
            while hi < len(texts) and (hi == lo or total + len(texts[hi]) <= SCAN_BYTES):
                total += len(texts[hi])
                hi += 1
            self._scan(texts, lo, hi, out)
            lo = hi
        for found in out:
            found.sort()
        return out

    def _scan(self, texts, lo: int, hi: int, out) -> None:
        brk = bytes([BREAK])
        whole = brk.join(texts[lo:hi]) + brk
        begins = np.cumsum([0, *[len(t) + 1 for t in texts[lo:hi]]])
        bits = [a.scan(np.frombuffer(whole, np.uint8)) for a in self.automata]
        for k, rule in enumerate(self.rules):
            inside = np.concatenate(([0], (bits[k // TOGETHER] >> k % TOGETHER) & 1, [0])).astype(np.int8)
            edges = np.flatnonzero(np.diff(inside)).reshape(-1, 2)
            first, after = edges[:, 0], edges[:, 1]
            if rule.counted == "tail":
                keep = np.flatnonzero(after - first >= rule.least)
            elif self.fixed[k]:
                keep = np.flatnonzero(after - first - 1 + self.fixed[k] >= rule.least)
            else:
                keep = np.arange(len(first))
            for m in keep.tolist():
                doc = int(np.searchsorted(begins, first[m], side="right")) - 1
                base = int(begins[doc])
                if self.fixed[k]:
                    start = int(first[m]) + 1 - self.fixed[k]
                else:
                    floor = max(base, int(after[m - 1]) if m else 0)
                    start = self.automata[k // TOGETHER].starts_of[k % TOGETHER](whole, int(first[m]) + 1, floor)
                    if rule.counted == "match" and after[m] - start < rule.least:
                        continue
                out[lo + doc].append((start - base, k, int(after[m]) - base))


def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    return worker_cache(f"scanner {rules}", lambda: Scanner(rules))


def _in_characters(text: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same matches with offsets in code points."""
    if not found:
        return []
    before = np.append(0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))
    return [(int(before[a]), k, int(before[b])) for a, k, b in found]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """(doc_id, spans) of every row: spans of (kind, start, end) in code points, by start and then in the order of the rules.

    A null or empty text has none. Rows are scanned each for itself, so repeated rows and null doc_ids need no rule. An empty
    table gives no rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(rules)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            spans = [
                [{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in _in_characters(t, found)]
                for t, found in zip(texts, scanner.matches(texts), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(kind))], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = ALL_RULES) -> DataFrame:
    """The same rows and columns, with every secret in ``text`` replaced by its kind in angle brackets.

    Overlapping spans are replaced once, by the kind that begins first. ``n_chars`` follows the text if there is such a
    column. A null text stays null, and a text without secrets is returned unchanged. All other columns pass through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(rules)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            found = scanner.matches([t or b"" for t in texts])
            for i, spans in enumerate(found):
                if spans:
                    parts, done = [], 0
                    for a, k, b in spans:
                        if b <= done:
                            continue
                        if a >= done:
                            parts += [texts[i][done:a], f"<{rules[k].kind}>".encode()]
                        done = b
                    texts[i] = b"".join([*parts, texts[i][done:]])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.binary()).cast(batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        changed = F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return out
