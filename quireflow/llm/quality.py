"""Quality rules: word and line statistics, and bands of zstandard ratios over whole texts and fixed chunks.

The longer a text, the better it compresses, so the limits depend on its length: they are given at some lengths, and those
between are interpolated over the logarithm of the length. The limits were set on labelled texts of sf0.1: low ones under
the lowest clean text of each length (by 0.01 to 0.02), high ones over the highest (by 0.06).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, as_batches, cuts, mixed, short_batches, slices, text_buffer, word_bounds, word_hasher

#: (bytes, lowest ratio, highest ratio) of compressed to raw bytes, for a whole text and for a chunk of it; the ends hold beyond.
WHOLE_BANDS = ((64, 0.30, 2.00), (128, 0.50, 1.05), (256, 0.53, 0.85), (512, 0.505, 0.75), (1024, 0.475, 0.65), (2048, 0.45, 0.58), (4096, 0.425, 0.55), (8192, 0.405, 0.53), (16384, 0.39, 0.52), (65536, 0.36, 0.50), (1 << 20, 0.33, 0.50))
CHUNK_BANDS = ((64, 0.30, 2.00), (128, 0.50, 1.05), (256, 0.53, 0.85), (512, 0.505, 0.75), (1024, 0.49, 0.63), (2048, 0.455, 0.57))
CHUNK_BYTES = 1024
#: A text goes if more than this share of its chunks lies outside their bands. A text of under two chunks is one chunk.
BAD_CHUNKS = 0.25
LEVEL = 3
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True

_RESULT = pa.schema([(n, pa.int64()) for n in ("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("whole_ratio", pa.float64()), ("n_chunks", pa.int64()), ("low_chunks", pa.int64()), ("high_chunks", pa.int64()), ("band_failed", pa.bool_())])
RESULT_TYPES = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, whole_ratio double, n_chunks long, low_chunks long, high_chunks long, band_failed boolean"


def band(size: int | np.ndarray, bands: tuple) -> tuple:
    """The lowest and the highest ratio for texts of so many bytes."""
    at, low, high = np.array(bands, float).T
    x = np.log2(np.maximum(size, 1))
    return np.interp(x, np.log2(at), low), np.interp(x, np.log2(at), high)


def compression(raw: bytes, compress, whole: tuple = WHOLE_BANDS, chunk: tuple = CHUNK_BANDS) -> tuple[float, int, int, int, bool]:
    """Whole ratio, chunks, chunks under and over their band, and the verdict. No bytes: ratio 0, no chunk, no failure."""
    if not raw:
        return 0.0, 0, 0, 0, False
    ratio = len(compress(raw)) / len(raw)
    low, high = band(len(raw), whole)
    # the rest that is shorter than a chunk is read with the chunk before it
    n = max(1, len(raw) // CHUNK_BYTES)
    ends = np.append(np.arange(1, n) * CHUNK_BYTES, len(raw))
    size = np.diff(ends, prepend=0)
    view = memoryview(raw)
    parts = np.array([len(compress(view[b - k : b])) for b, k in zip(ends.tolist(), size.tolist(), strict=True)]) / size
    least, most = band(size, chunk)
    under, over = int((parts < least).sum()), int((parts > most).sum())
    return ratio, n, under, over, bool(not low <= ratio <= high or under + over > BAD_CHUNKS * n)


def repeated_words(words: np.ndarray, offsets: np.ndarray, width: int = 3) -> np.ndarray:
    """For each row, the words inside a window of `width` words that its text has twice or more."""
    n = len(words)
    if n < width:
        return np.zeros(len(offsets) - 1, np.int64)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    inside = row[: n - width + 1] == row[width - 1 :]
    step = 1 << 18
    key = np.empty(n - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(key), step):
            b = min(a + step, len(key))
            part = mixed(row[a:b].astype(np.uint64))
            for k in range(width):
                part = mixed(part + mixed(words[k + a : k + b] + np.uint64(k + 1)))
            key[a:b] = part
    order = np.sort(key[inside])
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    covered = np.zeros(n + 1, bool)
    for a in range(0, len(key) if len(twice) else 0, step):
        b = min(a + step, len(key))
        again = inside[a:b] & (twice[np.minimum(np.searchsorted(twice, key[a:b]), len(twice) - 1)] == key[a:b])
        for k in range(width):
            covered[a + k : b + k] |= again
    return np.add.reduceat(covered, np.minimum(offsets[:-1], n), dtype=np.int64) * (np.diff(offsets) > 0)


class Measure:
    """The columns of _RESULT but the id, for runs of rows of bounded size; a long row is measured segment by segment."""

    def __init__(self):
        import zstandard

        self.hasher, self.compress = word_hasher(), zstandard.ZstdCompressor(level=LEVEL).compress

    def words(self, part: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the words, the rows' offsets among them, and the code points in words and the symbols of each row."""
        starts, ends, at = word_bounds(part, own)
        points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80, dtype=np.int32)])
        chars = np.concatenate([[0], np.cumsum(points[ends] - points[starts], dtype=np.int64)])
        symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[part], dtype=np.int32)])
        words = self.hasher(part, starts, ends, lower=False) if len(starts) else np.zeros(0, np.uint64)
        return words, at, np.diff(chars[at]), np.diff(symbols[own]).astype(np.int64)

    def lines(self, part: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the lines that have a word, and the rows' offsets among them."""
        starts, ends, _ = word_bounds(part, own, _NEWLINE)
        if not len(starts):
            return np.zeros(0, np.uint64), np.zeros(len(own), np.int64)
        full = np.logical_or.reduceat(~_BLANK[part], starts)
        starts, ends = starts[full], ends[full]
        return self.hasher(part, starts, ends, lower=False), np.searchsorted(starts, own)

    def long(self, part: np.ndarray) -> tuple:
        """words() and lines() of one long row."""
        pairs = lambda bounds: zip(bounds, bounds[1:], strict=False)
        whole = lambda x, y: (part[x:y], np.array([0, y - x]))
        found = [self.words(*whole(x, y)) for x, y in pairs(cuts(part))]
        after = lambda low, high: np.flatnonzero(part[low - 1 : high - 1] == 0x0A) + low
        lines = np.concatenate([self.lines(*whole(x, y))[0] for x, y in pairs(cuts(part, after))])
        words = np.concatenate([x[0] for x in found])
        return words, np.array([0, len(words)]), sum(x[2] for x in found), sum(x[3] for x in found), lines, np.array([0, len(lines)])

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, int, dict[str, object]]]:
        data, offsets = text_buffer(column)
        for a, b in slices(offsets):
            part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            words, at, chars, symbols, lines, line_at = self.long(part) if b - a == 1 and len(part) > SLICE_BYTES else (*self.words(part, own), *self.lines(part, own))
            dup = [int(y - x) - len(np.unique(lines[x:y])) for x, y in zip(line_at, line_at[1:], strict=False)]
            found = [compression(part[x:y].tobytes(), self.compress) for x, y in zip(own, own[1:], strict=False)]
            values = [np.diff(at), chars, symbols, dup, repeated_words(words, at), *zip(*found, strict=True)]
            yield a, b, dict(zip(_RESULT.names[1:], values, strict=True))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of RESULT_TYPES for each document, over its whole text; a null text counts as empty."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure()
        for batch in batches:
            for a, b, columns in measure(batch.column(1)):
                yield as_batches({"id": batch.column(0).slice(a, b - a)} | columns, _RESULT)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, RESULT_TYPES)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """measured() with base_failed (too few words, or too many repeated ones) and kept (neither that nor band_failed).

    An empty, blank or null text has no words and fails the base rules. Each row is judged alone, so repeated rows get
    equal verdicts and an empty table gives none. Only the two named columns are read.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return measured(docs, id_col, text_col).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~F.col("band_failed")).withColumnRenamed("id", id_col)


def passing(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that judged() keeps; each row is judged where it stands.

    Empty, blank and null texts go; repeated rows stay or go together; a null id or other null column changes nothing; an
    empty table stays empty, and further columns may have any names.
    """
    short_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure()
        for batch in batches:
            for a, b, found in measure(batch.column(at)):
                n, repeated = np.asarray(found["n_words"]), np.asarray(found["n_repeat_words"])
                good = (n >= MIN_WORDS) & (100 * repeated <= MAX_REPEAT_PERCENT * n) & ~np.array(found["band_failed"], bool)
                yield batch.slice(a, b - a).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
