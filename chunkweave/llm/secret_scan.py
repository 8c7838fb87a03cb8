"""Secret scan: patterns, and sliding-window entropy per character class (operator 10).

Besides three base patterns, candidate strings (long runs of token characters)
are scanned by a window whose Shannon entropy is kept from incremental
character counts; windows over the threshold of their character class merge
into spans.  Candidates on the allow-list are suppressed.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkweave.session import small_batches

WINDOW = 20
#: Bits per character that a window must reach, by the class of its candidate.
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "base64": 3.7}
KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # the maximal runs of 32 and more
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
#: Candidates that are no secrets: those without a digit (words, names, paths) or without a letter, UUIDs, dates, words with a number at the end.
ALLOW = (
    r"[^0-9]+",
    r"[^A-Za-z]+",
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}([T_-].*)?",
    r"([a-z]+[-_/])+[0-9]+",
)
#: count * log2(count); a window holds one character more for a moment
_PLAIN = [(w * math.log2(w) if w else 0.0) for w in range(WINDOW + 2)]


def character_class(s: str) -> str:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        return "hex"
    return "alnum" if s.isalnum() else "base64"


def entropy_spans(s: str, window: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS) -> list[tuple[int, int]]:
    """Merged spans of the windows of s whose entropy reaches its class's threshold."""
    limit = thresholds[character_class(s)]
    plain = _PLAIN if window == WINDOW else [(w * math.log2(w) if w else 0.0) for w in range(window + 2)]
    counts: dict[str, int] = {}
    total = 0.0  # sum of count * log2(count): entropy = log2(window) - total / window
    most = (math.log2(window) - limit) * window + 1e-9
    spans: list[tuple[int, int]] = []
    for k, c in enumerate(s):
        had = counts.get(c, 0)
        counts[c] = had + 1
        total += plain[had + 1] - plain[had]
        if k >= window:
            d = s[k - window]
            had = counts[d]
            counts[d] = had - 1
            total += plain[had - 1] - plain[had]
        if k >= window - 1 and total <= most:
            a, b = k - window + 1, k + 1
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], b)
            else:
                spans.append((a, b))
    return spans


def scan(text: str, allow: re.Pattern) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all spans, by start and kind; code points, end exclusive."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    covered: list[list[int]] = []
    for a, _, b in sorted(found):
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    at = 0  # both lists are in order
    for m in _CANDIDATE.finditer(text):
        s = m.group()
        if allow.fullmatch(s):
            continue
        for a, b in entropy_spans(s):
            a, b = a + m.start(), b + m.start()
            while at < len(covered) and covered[at][1] <= a:
                at += 1
            k = at
            while k < len(covered) and covered[k][0] < b:  # what a base span has already is left out, the rest stays
                if a < covered[k][0]:
                    found.append((a, 3, covered[k][0]))
                a = covered[k][1]
                k += 1
            if a < b:
                found.append((a, 3, b))
    return sorted(found)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span (overlaps joined) replaced by its first kind in brackets."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, k, b in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([a, k, b])
    for a, k, b in merged:
        out += [text[at:a], f"[{KINDS[k]}]"]
        at = b
    return "".join([*out, text[at:]])


def _pattern(allow: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(f"(?:{a})" for a in allow) or r"(?!)")


def find_secrets(docs: DataFrame, allow: tuple[str, ...] = ALLOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row per input row.

    Whole texts are scanned; a null text counts as empty and has no span.  The
    counts and base_sha256 are of the base patterns only; spans has the
    method's too, which never overlap a base span.  Ids are carried as they are.
    """

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = _pattern(allow)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text in batch.column(1).to_pylist():
                spans = scan(text or "", pattern)
                base = [s for s in spans if s[1] < 3]
                for k in range(3):
                    out[k].append(sum(s[1] == k for s in base))
                out[3].append(hashlib.sha256(listed(base).encode()).hexdigest())
                out[4].append(listed(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string()), pa.array(out[4], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, allow: tuple[str, ...] = ALLOW, text_col: str = "text") -> DataFrame:
    """The same rows and columns, each secret in the text replaced; null texts stay null."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = _pattern(allow)
        for batch in batches:
            at = batch.schema.names.index(text_col)
            texts = [t if t is None else redact(t, scan(t, pattern)) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
