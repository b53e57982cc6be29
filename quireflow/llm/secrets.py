"""Secret scans: fixed patterns, and windows of high Shannon entropy over candidate strings of each character class.

A candidate is a maximal run of a class's characters. A window slides over it; the counts of its characters, and with
them the sum of c * log2(c), change by one character in and one out, so a step costs the same for any window. The
allow-list judges windows, not candidates: a window is left out if it touches a UUID or a placeholder's word, or if more
than half of it are parts that read like words or numbers. So what stands beside a harmless part is still found. Windows
that overlap above the threshold become one span.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, as_batches, cuts, short_batches, slices, text_buffer

ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24


class CharClass(NamedTuple):
    kind: str
    alphabet: bytes
    window: int
    bits: float


#: Entropy bits a character over a window: 24 hex digits reach 4 at most, 20 base64 characters log2(20) = 4.32.
CLASSES = (
    CharClass("entropy_hex", b"0123456789abcdefABCDEF", 24, 3.0),
    CharClass("entropy_base64", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 20, 3.7),
)
#: In the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", *(c.kind for c in CLASSES))
#: What no window may touch: UUIDs, and words that stand for a value.
HARMLESS = re.compile(rb"(?<![0-9a-fA-F])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-fA-F])|(?i:example|placeholder|changeme|xxxx+|sample|dummy)")
#: Parts between separators that read like words or numbers: digits alone, or letters in one case, in parts of one
#: case (as in CamelCase), or too few to tell. No match is tried twice over the same letters.
PLAIN = re.compile(rb"[0-9]+|[A-Z]*[a-z]+|[A-Z]+|(?:[A-Z][a-z]++|[a-z]{2,}+|[A-Z]{3,}+)++|[A-Za-z0-9]{1,3}")
_PARTS = re.compile(rb"[^/_+-]+")

_MEMBERS = []
for _c in CLASSES:
    _at = np.zeros(256, bool)
    _at[list(_c.alphabet)] = True
    _MEMBERS.append(_at)
_HEX_DIGIT = np.zeros(256, bool)
_HEX_DIGIT[list(b"0123456789abcdef")] = True
_WEIGHT = [0.0] + [c * math.log2(c) for c in range(1, 257)]


def plain_places(run: bytes) -> tuple[list[int], list[int]]:
    """Sums over the places before each: of those that a window must not touch, and of those that read like words or numbers."""
    touch, plain = bytearray(len(run)), bytearray(b"\1" * len(run))
    for m in _PARTS.finditer(run):  # separators are plain
        if not PLAIN.fullmatch(m[0]):
            plain[m.start() : m.end()] = bytes(m.end() - m.start())
    for m in HARMLESS.finditer(run):
        touch[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    return [0, *itertools.accumulate(touch)], [0, *itertools.accumulate(plain)]


def entropy_spans(run: bytes, window: int, bits: float, allow: bool = True) -> list[tuple[int, int]]:
    """Spans of overlapping windows whose entropy is at least `bits` a character; a run shorter than a window has none.

    With `allow`, windows that the allow-list knows as harmless are left out.
    """
    if len(run) < window:
        return []
    touch, plain = plain_places(run) if allow else ([0] * (len(run) + 1),) * 2
    counts, weight = [0] * 256, 0.0
    most = window * (math.log2(window) - bits) + 1e-9  # entropy >= bits, as a bound on the sum of c * log2(c)
    spans: list[list[int]] = []
    for i, byte in enumerate(run):
        c = counts[byte]
        weight += _WEIGHT[c + 1] - _WEIGHT[c]
        counts[byte] = c + 1
        if i >= window:
            old = run[i - window]
            c = counts[old]
            weight += _WEIGHT[c - 1] - _WEIGHT[c]
            counts[old] = c - 1
        if i >= window - 1 and weight <= most:
            first = i - window + 1
            if touch[i + 1] > touch[first] or 2 * (plain[i + 1] - plain[first]) > window:
                continue
            if spans and first <= spans[-1][1]:
                spans[-1][1] = i + 1
            else:
                spans.append([first, i + 1])
    return [(a, b) for a, b in spans]


def runs_of(member: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of at least so many members."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], member, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= least
    return starts[long], ends[long]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed patterns: leftmost, non-overlapping matches of a kind, short ones dropped."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]


def scan(part: np.ndarray, own: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each text of a slice, its spans (start, kind's number, end) in code points, in the listed order.

    Byte masks find the texts in which a pattern can match at all: an assignment needs a colon or an equals sign, an
    access key its prefix, a hex string a long enough run. Only those are searched by the patterns.
    """
    n = len(own) - 1
    look = np.zeros(n, bool)
    spans: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    row = lambda at: np.searchsorted(own, at, side="right") - 1
    breaks = np.zeros(len(part) + 1, bool)
    breaks[own] = True
    look[row(np.flatnonzero((part == 0x3A) | (part == 0x3D)))] = True
    raw = part.tobytes()
    at = raw.find(b"AKIA")
    while at >= 0:
        look[row(at)] = True
        at = raw.find(b"AKIA", at + 4)

    def within(member: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
        starts, ends = runs_of(member, least)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            cuts = [a, *(a + 1 + np.flatnonzero(breaks[a + 1 : b])).tolist(), b]  # a run may reach over into the next text
            for x, y in zip(cuts, cuts[1:], strict=False):
                if y - x >= least:
                    yield int(row(x)), x, y

    for i, _, _ in within(_HEX_DIGIT[part], LEAST_HEX):
        look[i] = True
    windows = []
    for k, (c, member) in enumerate(zip(CLASSES, _MEMBERS, strict=True)):
        for i, a, b in within(member[part], c.window):
            windows += [(i, a + x, 3 + k, y - x) for x, y in entropy_spans(raw[a:b], c.window, c.bits)]
    for i in np.flatnonzero(look).tolist():
        spans[i] = base_spans(raw[own[i] : own[i + 1]].decode())
    if windows:  # bytes to code points by one sum; the characters of a candidate are one byte each
        points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80, dtype=np.int32)])
        for i, x, kind, size in windows:
            before = int(points[x] - points[own[i]])
            spans[i].append((before, kind, before + size))
    for found in spans:
        found.sort()
    return spans


def borders(part: np.ndarray, low: int, high: int) -> np.ndarray:
    """Places from low to high - 1 in front of which a text may be cut: no pattern and no candidate reaches over them.

    These are the places after a white space other than a space, and after a single space that stands beside neither a
    colon nor an equals sign.
    """
    low = max(low, 2)
    two, one, now = part[low - 2 : high - 2], part[low - 1 : high - 1], part[low:high]
    good = (one >= 0x09) & (one <= 0x0D) | (one == 0x20) & ~_JOINS[two] & ~_JOINS[now]
    return np.flatnonzero(good) + low


_JOINS = np.zeros(256, bool)
_JOINS[list(b" :=")] = True


def scanned(column: pa.Array) -> Iterator[tuple[int, int, list[list[tuple[int, int, int]]]]]:
    """(first row, last row, spans of each), for runs of rows of bounded size; a long row is scanned segment by segment."""
    data, offsets = text_buffer(column)
    for a, b in slices(offsets):
        part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if b - a > 1 or len(part) <= SLICE_BYTES:
            yield a, b, scan(part, own)
            continue
        found, before = [], 0
        bounds = cuts(part, lambda low, high: borders(part, low, high))  # noqa: B023
        for x, y in zip(bounds, bounds[1:], strict=False):
            found += [(s + before, kind, e + before) for s, kind, e in scan(part[x:y], np.array([0, y - x]))[0]]
            before += int(((part[x:y] & 0xC0) != 0x80).sum())
        yield a, b, [found]


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans array<struct<kind, start, end>>) for each document, in code points, end exclusive, by start and kind.

    A null, empty or blank text has no spans. Rows are scanned one by one: repeated rows have equal spans, an empty table
    gives no rows, and columns other than the two named ones are not read.
    """
    short_batches(docs.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("spans", pa.list_(_SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, found in scanned(batch.column(1)):
                yield as_batches({"id": batch.column(0).slice(a, b - a), "spans": [[{"kind": KINDS[k], "start": x, "end": y} for x, k, y in one] for one in found]}, schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, spans array<struct<kind string, start long, end long>>").withColumnRenamed("id", id_col)


def span_list(spans: F.Column, kinds: tuple[str, ...] = KINDS) -> F.Column:
    """The spans of the given kinds as kind:start:end, joined by commas."""
    held = F.filter(spans, lambda s: s.kind.isin(*kinds))
    return F.array_join(F.transform(held, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of every text replaced by the mark, overlapping spans by one; all columns stay.

    Texts without spans, and null texts, stay as they are; a null id or repeated rows make no difference, and an empty table
    stays empty.
    """
    short_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    target = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            changed: dict[int, str] = {}
            for a, _, each in scanned(column):
                for i, spans in enumerate(each, a):
                    if spans:
                        text, done, out = column[i].as_py(), 0, []
                        for x, _, y in spans:
                            if x >= done:
                                out += [text[done:x], mark]
                            done = max(done, y)
                        changed[i] = "".join(out) + text[done:]
            if changed:
                texts = column.to_pylist()
                for i, text in changed.items():
                    texts[i] = text
                arrays = [c if k != at else pa.array(texts, type=column.type) for k, c in enumerate(batch.columns)]
                batch = pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, target)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
