"""Secrets in texts: assignments, access keys, hex keys, and runs of high entropy.

The first three are patterns. Beside them, candidate strings are judged by the Shannon entropy of a
window sliding over them, in every character class, with counts updated a character a step; strings
and parts of paths that an allow-list knows as harmless are suppressed, their neighbours are not.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lexforge.session import importable

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
#: Without one of these a text has no assignment.
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: Window, and bits a character that a window of each class must reach.
WINDOW = 20
CLASSES = (
    ("hex", frozenset("0123456789abcdefABCDEF"), 3.0),
    ("alnum", frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), 3.6),
    ("base64", frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/=_-"), 3.8),
)
#: Harmless by form: identifiers, ids of one repeated alphabet, plain numbers, paths and words.
ALLOW = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(r"[0-9+/_=-]+"),
    re.compile(r"[A-Za-z+/_=-]+"),
    re.compile(r"(.)\1+"),
    re.compile(r"(?i).*(example|sample|dummy|placeholder|xxxx).*"),
)
#: Those that speak of one part of a path only.
ALLOW_PART = (ALLOW[0], ALLOW[3], ALLOW[4])
PART = re.compile(r"[^/]+")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, sorted; spans that touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def within(spans: list[tuple[int, int]], a: int, b: int) -> list[tuple[int, int]]:
    """Those of merged spans that overlap [a, b)."""
    return spans[bisect_right(spans, a, key=lambda x: x[1]) : bisect_left(spans, b, key=lambda x: x[0])]


def entropy_runs(s: str, window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal runs (start, end) covered by windows within any one class that reach its entropy.

    Sum of c log c over the counts is updated as one character enters and one leaves.
    """
    part = [c * math.log2(c) if c else 0.0 for c in range(window + 1)]
    runs: list[tuple[int, int]] = []
    for _, chars, least in CLASSES:
        at = 0
        while at < len(s):
            if s[at] not in chars:
                at += 1
                continue
            end = at
            while end < len(s) and s[end] in chars:
                end += 1
            counts, total = Counter(), 0.0
            for i in range(at, end):
                if i - at >= window:  # one leaves before one enters, so a count never passes the window
                    c = counts[s[i - window]]
                    total += part[c - 1] - part[c]
                    counts[s[i - window]] = c - 1
                c = counts[s[i]]
                total += part[c + 1] - part[c]
                counts[s[i]] = c + 1
                if i - at >= window - 1 and math.log2(window) - total / window >= least - 1e-9:  # sums drift in their last digits
                    if runs and runs[-1][0] <= i - window + 1 <= runs[-1][1]:
                        runs[-1] = (runs[-1][0], max(runs[-1][1], i + 1))  # another class may reach further
                    else:
                        runs.append((i - window + 1, i + 1))
            at = end
    return merged(runs)


def remaining(s: str, a: int, b: int, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of the run s[a:b] beside ``gone`` (merged). An untouched run stays as it is; parts of a
    cut one lose slashes at their ends, and stand from half a window on unless the allow-list knows them."""
    touching = within(gone, a, b)
    if not touching:
        return [(a, b)]
    parts, at = [], a
    for x, y in [*touching, (b, b)]:
        if at < x:
            part = s[at:x]
            start, end = at + len(part) - len(part.lstrip("/")), at + len(part.rstrip("/"))
            if end - start >= WINDOW // 2 and not any(r.fullmatch(s, start, end) for r in ALLOW):
                parts.append((start, end))
        at = max(at, y)
    return parts


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed; code points, end exclusive. Null text: none."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    base = merged([b[1:] for b in found])
    for m in CANDIDATE.finditer(text):
        s, at = m[0], m.start()
        if any(a.fullmatch(s) for a in ALLOW if a not in ALLOW_PART):
            continue
        runs = entropy_runs(s)
        if not runs:
            continue
        gone = [(p.start(), p.end()) for p in PART.finditer(s) if any(a.fullmatch(p[0]) for a in ALLOW_PART)]
        gone = merged(gone + [(x - at, y - at) for x, y in within(base, at, m.end())])
        for run in runs:
            found += [("entropy", a + at, b + at) for a, b in remaining(s, *run, gone)]
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0]), f[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: n_assign, n_access, n_hex, base_sha256, spans, n_entropy.

    A null or empty text has no spans; a long text takes time in proportion; repeated rows each give a row; spans
    that start together come in the order of kinds; an empty table gives no rows; other columns are ignored. Base
    spans of each kind stand whatever the entropy says; entropy spans never overlap them.
    """
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column("text").to_pylist():
                spans = find(t)
                n = Counter(k for k, _, _ in spans)
                base = joined([s for s in spans if s[0] != "entropy"])
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(base.encode()).hexdigest(), joined(spans), n["entropy"]))
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types))], names)

    types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"]
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_entropy bigint")
