"""Problem 8: personal information in free text.

Every text is cut into overlapping windows that go through a character-level bidirectional LSTM with CRF
transitions (pii_model), trained in numpy from labelled spans (pii_train). Of two windows that share characters,
each decides those that are farther from its edge, and spans that run across the seam are joined. What the tagger
finds is then moved to whole words, and held against the least that its type demands: an email address has a sign
for `at`, a phone number six digits, an identity number a digit, an address a letter, a name a letter.

Defined results. Null, empty and blank texts have no mentions. Characters are counted as Unicode code points from
0. Repeated rows give repeated mentions, which `mentions` returns once for each id. Very long texts are tagged
window by window, whole. Empty table: no rows. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pii_model as M
from .pii_labels import TYPES

#: Windows that go through the tagger at once.
BATCH = 512
PLACEHOLDERS = {t: f"[{t.upper()}]" for t in TYPES}
_BETWEEN_EMAILS = re.compile(r"\s*[;,]\s*(?=\S*(?:@|\s?[\[(]))")


def fit_to_words(text: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """The span moved to whole words, or None when it cannot be of its type."""
    n = len(text)
    while a < b and text[a].isspace():
        a += 1
    if a >= b:
        return None
    if kind == "name":
        while a < b and not text[a].isalpha():
            a += 1
        while a > 0 and text[a - 1].isalpha():
            a -= 1
        while b < n and text[b].isalpha() and b > a:
            b += 1
        return (a, b) if any(c.isalpha() for c in text[a:b]) and b - a > 1 else None
    if kind == "email":
        while a > 0 and (text[a - 1].isalnum() or text[a - 1] in "._+-"):
            a -= 1
        while a < b and not text[a].isalnum():
            a += 1
        while b < n and (text[b].isalnum() or (text[b] in ".-_" and b + 1 < n and text[b + 1].isalnum())):
            b += 1
        return (a, b)
    if kind == "phone":
        while a < b and not (text[a].isdigit() or text[a] in "+("):
            a += 1
        while a > 0 and (text[a - 1].isdigit() or text[a - 1] in "+("):
            a -= 1
        while b < n and text[b].isdigit():
            b += 1
        return (a, b) if sum(c.isdigit() for c in text[a:b]) >= 6 else None
    if kind == "id_number":
        while a < b and not text[a].isalnum():
            a += 1
        while a > 0 and (text[a - 1].isalnum() or (text[a - 1] in "-./" and a > 1 and text[a - 2].isalnum())):
            a -= 1
        while b < n and (text[b].isalnum() or (text[b] in "-./" and b + 1 < n and text[b + 1].isalnum())):
            b += 1
        return (a, b) if any(c.isdigit() for c in text[a:b]) else None
    while a < b and not text[a].isalnum():
        a += 1
    while a > 0 and text[a - 1].isalnum():
        a -= 1
    while b < n and text[b].isalnum():
        b += 1
    return (a, b) if any(c.isalpha() for c in text[a:b]) else None


def spans_of(tags: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, type) of the runs in a text's tags."""
    on = tags > 0
    if not on.any():
        return []
    kind = (tags + 1) // 2
    begin = on & ((tags % 2 == 1) | np.r_[True, kind[1:] != kind[:-1]])
    out = []
    for a in np.flatnonzero(begin).tolist():
        b = a + 1
        while b < len(tags) and tags[b] == 2 * kind[a]:
            b += 1
        out.append((a, b, TYPES[kind[a] - 1]))
    return out


def _apart(text: str, found: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """The spans, those of several email addresses in a list taken apart."""
    for a, b, kind in found:
        if kind == "email":
            while m := _BETWEEN_EMAILS.search(text, a, b):
                if m.start() > a:
                    yield a, m.start(), kind
                a = m.end()
        yield a, b, kind


def reconcile(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans at whole words, those that then meet joined or, of different types, the earlier one kept."""
    out: list[tuple[int, int, str]] = []
    for a, b, kind in _apart(text, found):
        fit = fit_to_words(text, a, b, kind)
        if fit is None:
            continue
        a, b = fit
        if out and a < out[-1][1]:
            if out[-1][2] == kind:
                out[-1] = (out[-1][0], max(b, out[-1][1]), kind)
            continue
        out.append((a, b, kind))
    return out


def find(texts: list[str | None], model: dict[str, np.ndarray], batch: int = BATCH) -> list[list[tuple[int, int, str]]]:
    """The mentions (start, end, type) in each text."""
    rows, where = [], []
    for i, t in enumerate(texts):
        if t and not t.isspace():
            x = M.classes(t)
            for s in M.starts(len(x)):
                rows.append(x[s : s + M.WINDOW])
                where.append((i, s))
    tags = {i: np.zeros(len(texts[i]), np.int8) for i, _ in where}
    order = sorted(range(len(rows)), key=lambda k: -len(rows[k]))  # windows of like length share a batch, which is cut to it
    for lo in range(0, len(rows), batch):
        part = order[lo : lo + batch]
        width = -(-max(len(rows[k]) for k in part) // M.CHARS) * M.CHARS
        x = np.zeros((len(part), width), np.int16)
        for j, k in enumerate(part):
            x[j, : len(rows[k])] = rows[k]
        for k, got in zip(part, M.tag(model, x)):
            i, s = where[k]
            first = s + M.EDGE if s else 0
            end = min(s + M.WINDOW, len(tags[i]))
            last = end if end == len(tags[i]) else end - M.EDGE
            tags[i][first:last] = got[first - s : last - s]
    return [reconcile(t, spans_of(tags[i])) if i in tags else [] for i, t in enumerate(texts)]


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """text with a typed placeholder for each mention."""
    out, at = [], 0
    for a, b, kind in found:
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join([*out, text[at:]])


def _batches(batches: Iterator[pa.RecordBatch], size: int = 2000) -> Iterator[tuple[list, list]]:
    for b in batches:
        for lo in range(0, b.num_rows, size):
            s = b.slice(lo, size)
            yield s.column(0).to_pylist(), s.column(1).to_pylist()


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, pii_type, start_char, end_char): one row for each mention. docs: (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = M.load()
        for ids, texts in _batches(batches):
            rows = [(i, k, a, b) for i, found in zip(ids, find(texts, model)) for a, b, k in found]
            cols = list(zip(*rows)) or [()] * 4
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "pii_type", "start_char", "end_char"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").rlike(r"\S"))
    return rows.mapInArrow(run, "doc_id long, pii_type string, start_char long, end_char long")


def redacted(docs: DataFrame) -> DataFrame:
    """(doc_id, text, mentions): texts with placeholders, and how many there are; null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = M.load()
        for ids, texts in _batches(batches):
            found = find(texts, model)
            new = [t if t is None else redact(t, f) for t, f in zip(texts, found)]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(new, pa.string()), "mentions": pa.array([len(f) for f in found], pa.int32())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string, mentions int")
