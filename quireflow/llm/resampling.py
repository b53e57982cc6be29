"""Draws documents that look like a target corpus: importance weights of hashed n-grams, and Gumbel noise.

A feature is a run of up to `most` words, and its bucket is the CRC-32 of the words joined by spaces. The CRC of every
word is taken once; those of longer runs follow from them, since a CRC is linear over GF(2): the CRC of a text followed
by another one is the first CRC, shifted by the other's length, plus the other's CRC. A shift by a number of bytes is a
32 by 32 matrix of bits, kept for each power of two, so n-grams are never put together as strings.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, cuts, fresh_path, lowered, short_batches, slices, staged, text_buffer, word_bounds

BUCKETS, WORDS, PERCENT, SEED = 10_000, 20, 10, 2024
#: Fixed value: the polynomial of CRC-32 with its bits reversed.
POLYNOMIAL = 0xEDB88320
#: Words of ASCII letters (lower case), digits and whatever isn't ASCII: the bytes in between break them.
BREAKS = np.ones(256, bool)
BREAKS[0x30:0x3A] = BREAKS[0x61:0x7B] = BREAKS[0x80:] = False
#: Words of more bytes than this are left to zlib, one by one.
SHORT = 32


def byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(POLYNOMIAL), c >> 1).astype(np.uint32)
    return c


TABLE = byte_table()


def product(columns: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """A matrix over GF(2), as the 32 images of single bits, times vectors of 32 bits."""
    out = np.zeros(len(vectors), np.uint32)
    for bit in range(32):
        out ^= np.where((vectors >> np.uint32(bit)) & np.uint32(1), columns[bit], np.uint32(0)).astype(np.uint32)
    return out


def shifts(bits: int = 32) -> list[np.ndarray]:
    """Matrices that move a CRC past 1, 2, 4, ... bytes of zeros."""
    ones = (np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32)
    out = [TABLE[ones & np.uint32(255)] ^ (ones >> np.uint32(8))]
    for _ in range(bits - 1):
        out.append(product(out[-1], out[-1]))
    return out


SHIFTS = shifts()
SPACE = zlib.crc32(b" ")


def combined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of texts put together: those of the first parts, those of the second ones, and the second ones' lengths in bytes."""
    out = first.copy()
    for k, matrix in enumerate(SHIFTS):
        at = np.flatnonzero((length >> k) & 1)
        if len(at):
            out[at] = product(matrix, out[at])
        elif not (length >> k).any():
            break
    return out ^ second


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of every word, a byte of all words at a time."""
    size = ends - starts
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    at = np.flatnonzero(size <= SHORT)
    for k in range(SHORT):
        at = at[size[at] > k]
        if not len(at):
            break
        was = out[at]
        out[at] = TABLE[(was ^ data[starts[at] + k]) & np.uint32(255)] ^ (was >> np.uint32(8))
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    return out


def run_crcs(crcs: np.ndarray, size: np.ndarray, most: int) -> list[np.ndarray]:
    """CRCs of all runs of 1, 2, ... most words of a sequence; run k of n words begins at word k."""
    out = [crcs]
    for n in range(2, most + 1):
        before = out[-1][: len(crcs) - n + 1]
        if not len(before):
            break
        spaced = combined(before, np.full(len(before), SPACE, np.uint32), np.ones(len(before), np.int64))
        out.append(combined(spaced, crcs[n - 1 :], size[n - 1 :]))
    return out


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRCs and sizes of the words of all rows, and each row's offsets among the words; one long row is read by segments."""
    if len(offsets) > 2 or len(data) <= SLICE_BYTES:
        starts, ends, at = word_bounds(data, offsets, BREAKS)
        return word_crcs(data, starts, ends), ends - starts, at
    crcs, sizes = [], []
    bounds = cuts(data)
    for x, y in zip(bounds, bounds[1:], strict=False):
        crc, size, _ = hashed(data[x:y], np.array([0, 0, y - x]))
        crcs.append(crc)
        sizes.append(size)
    return np.concatenate(crcs), np.concatenate(sizes), np.array([0, sum(map(len, crcs))])


def bucketed(column: pa.Array, most: int, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, number of words of each row, row of each feature, its bucket), for runs of rows of bounded size."""
    data, offsets = text_buffer(column)
    for a, b in slices(offsets):
        crc, size, firsts = hashed(lowered(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a])
        words = np.diff(firsts)
        row = np.repeat(np.arange(len(words)), words)
        rows, found = [], []
        for n, run in enumerate(run_crcs(crc, size, most)):
            inside = row[: len(run)] == row[n:]  # a run doesn't go on into the next text
            rows.append(row[: len(run)][inside])
            found.append((run[inside] % np.uint32(buckets)).astype(np.int64))
        yield a, words, np.concatenate(rows), np.concatenate(found)


def bucket_counts(texts: DataFrame, text_col: str = "text", most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket. A task sends a row for each bucket that it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, found in bucketed(batch.column(0), most, buckets):
                total += np.bincount(found, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    return texts.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket: 1000 times the logarithm of how much more often the target has it, floored."""
    spark = source.sparkSession
    both = staged(spark.range(buckets).select(F.col("id").alias("bucket")).join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0), "counts")
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    d = lambda c: F.col(c).cast("double")
    ratio = ((d("t") + 1) * F.lit(float(all_s + buckets))) / ((d("s") + 1) * F.lit(float(all_t + buckets)))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weighed(docs: DataFrame, gain: list[int], id_col: str, text_col: str, most: int) -> DataFrame:
    """(id_col, n_words, n_features, weight) of each document."""
    values = np.asarray(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, words, row, found in bucketed(batch.column(1), most, len(values)):
                n = np.bincount(row, minlength=len(words))
                total = np.bincount(row, weights=values[found], minlength=len(words)).astype(np.int64)  # exact below 2**53
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(words)), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))], names=["id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, drawn: Column, order: list[Column], share: tuple[int, int]) -> DataFrame:
    """Adds rank to the best rows: of the n rows that may be drawn, floor(n * share) by order.

    Rows are dealt into ranges of the order, sorted inside them and written down with their place in their range; a range's
    first place follows from the sizes of those before it, a number for each range. No range is larger for a tie, as long as
    the order is total.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_path(spark, "ranked")
    keyed = rows.withColumn("_out", ~F.coalesce(drawn, F.lit(False)))
    dealt = keyed.repartitionByRange(n, "_out", *order).sortWithinPartitions("_out", *order)
    placed = dealt.withColumn("_range", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1)
    placed.write.parquet(path)
    held = spark.read.schema(placed.schema).parquet(path)
    sizes = {r["_range"]: r["n"] for r in held.groupBy("_range").agg(F.count_if(~F.col("_out")).alias("n")).collect()}  # a row for each range
    before, total = [], 0
    for k in sorted(sizes):
        before.append((k, total))
        total += sizes[k]
    starts = spark.createDataFrame(before, "_range int, _before long")
    place = F.col("_place") + F.col("_before")
    rank = F.when(~F.col("_out") & (place <= total * share[0] // share[1]), place)
    return held.join(F.broadcast(starts), "_range", "left").withColumn("rank", rank).drop("_range", "_place", "_before", "_out")  # a row for each range


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", most: int = 1, buckets: int = BUCKETS, least_words: int = WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(id_col, n_features, weight, score, rank) for each document; rank counts from 1 over those drawn, and is null for the others.

    Features are runs of 1 to `most` words, repeats counted. weight is the mean gain of a document's features, floored (0
    without any), and score adds Gumbel noise that hangs on seed and id alone. Of the documents with `least_words` words or
    more, the `percent` best are drawn, ties to the smaller id. A null or empty text has no words. Rows that repeat an id
    count and rank one by one; rows without an id have noise of their own, one value for all. Empty tables give an empty
    result; without target texts all gains come from the add-one terms. Other columns aren't read.
    """
    short_batches(docs.sparkSession)
    table = gains(bucket_counts(docs, text_col, most, buckets), bucket_counts(target, target_col, most, buckets), buckets)
    gain = [r["gain"] for r in table.orderBy("bucket").collect()]  # `buckets` numbers
    rows = weighed(docs, gain, id_col, text_col, most)
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0))))
    scored = rows.withColumn("score", F.col("weight") + noise)
    drawn = ranked(scored, F.col("n_words") >= least_words, [F.col("score").desc(), F.col("id").asc(), F.col("n_features").asc(), F.col("n_words").asc()], (percent, 100))
    return drawn.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
