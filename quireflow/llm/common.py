"""Shared folders, staged tables and the vectorised word kernel that the operators of this subpackage use."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in an Arrow batch. Texts are unbounded, so batches are kept short; kernels cut them further by bytes.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20
#: Bytes of text that a kernel works on at once; a longer text is cut inside, at places that change nothing.
SLICE_BYTES = 1 << 20

if TaskContext.get() is not None:  # Arrow's own pools keep what is freed; beside an executor's heap a worker has no room for that
    pa.set_memory_pool(pa.system_memory_pool())


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own, and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        held = context._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quireflow-"))
        return context._jsc.sc().getCheckpointDir().get()
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, and a lost executor loses nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of a sieve for each key, in all at most, and in one row of it.
SIEVE_EACH, SIEVE_MOST, SIEVE_ROW = 8, 1 << 26, 1 << 15


def sieved(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """rows with a boolean __maybe: where it is false, key isn't in ids (staged, one column of that name); of other keys one in eight is true.

    The hashed ids are bits of a table of 8 MB at most, which goes to all tasks, so rows stay where they are. With more ids
    than it has bits for, more rows are true.
    """
    rows_of = min(SIEVE_MOST // SIEVE_ROW, -(-ids.count() * SIEVE_EACH // SIEVE_ROW) or 1)
    slot = F.pmod(F.xxhash64(key), F.lit(rows_of * SIEVE_ROW))
    at = ids.select(F.floor(slot / SIEVE_ROW).alias("__at"), (slot % SIEVE_ROW).alias("__bit"))
    bits = staged(at.groupBy("__at").agg(F.bitmap_construct_agg("__bit").alias("__bits")), "sieve")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col("__bit") % 8).cast("int")) == 1, F.lit(False))
    placed = rows.withColumns({"__at": F.floor(slot / SIEVE_ROW), "__bit": slot % SIEVE_ROW})
    return placed.join(F.broadcast(bits), "__at", "left").withColumn("__maybe", hit).drop("__at", "__bit", "__bits")


def short_batches(spark: SparkSession) -> None:
    """Keep Arrow batches short, since one row may be a very long text.

    The two settings stay for the session: results are read lazily, so there is no moment at which to put them back.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column as one array, and the n + 1 offsets of its rows. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(offsets):
        return raw[:0], np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most so many bytes, or a single longer row."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end
        start = end


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return _LOWER[data]


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)  # fixed values: the 64-bit finaliser of MurmurHash3


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * _M1
        x ^= x >> np.uint64(33)
        x *= _M2
        x ^= x >> np.uint64(33)
    return x


def word_bounds(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words of all rows, and each row's offsets among the words.

    Words are maximal runs of bytes that `breaks` doesn't mark: by default `[^\\x20\\x09-\\x0D]+`.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = ~breaks[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    firsts = offsets[:-1]
    before[firsts[firsts < n]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    lasts = offsets[1:]
    after[lasts[lasts > 0] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)  # keeps the first k bytes of eight


class WordHasher:
    """64-bit hashes of words, eight bytes at a time: words of one length of up to eight bytes never share a hash.

    A longer word is chained through the mixer, one over LONG bytes goes through BLAKE2. Two words share a hash by chance
    alone, about once in 2**64 pairs; where ids hang on it, the caller compares bytes as well.
    """

    LONG = 64

    def __init__(self, seed: int = 20_240_131):
        self.seed = np.uint64(seed)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
        held = np.zeros(len(data) + 8, np.uint8)
        held[: len(data)] = _LOWER[data] if lower else data
        eight = np.ndarray(len(data) + 1, "<u8", held, strides=(1,))
        size = ends - starts
        out = mixed(size.astype(np.uint64) ^ self.seed)
        at = np.flatnonzero(size <= self.LONG)
        for k in range(0, self.LONG, 8):
            at = at[size[at] > k] if k else at
            if not len(at):
                break
            out[at] = mixed(out[at] ^ (eight[starts[at] + k] & _TAIL[np.minimum(size[at] - k, 8)]))
        for i in np.flatnonzero(size > self.LONG).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(held[starts[i] : ends[i]], digest_size=8).digest(), "little")
        return out


_SHARED: list[WordHasher] = []


def word_hasher() -> WordHasher:
    """The one hasher of a worker."""
    if not _SHARED:
        _SHARED.append(WordHasher())
    return _SHARED[0]


def cuts(data: np.ndarray, safe: Callable[[int, int], np.ndarray] | None = None, most: int = SLICE_BYTES) -> list[int]:
    """Bounds of segments of about `most` bytes, at places that safe(low, high) gives: cuts in front of bytes low to high - 1.

    By default a cut may follow a white space. A segment without a safe place in it is longer.
    """
    if safe is None:
        safe = lambda low, high: np.flatnonzero(_SPACE[data[low - 1 : high - 1]]) + low
    out, n = [0], len(data)
    while n - out[-1] > most:
        low, high = out[-1] + most // 2 + 1, out[-1] + most
        found = safe(low, high)
        at = int(found[-1]) if len(found) else n
        while not len(found) and high < n:  # look on, some bytes at a time
            found = safe(high, min(high + most, n))
            at = int(found[0]) if len(found) else n
            high += most
        out.append(at)
    return out if out[-1] == n else [*out, n]


def hashed_words(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, hashes of their words, offsets of the rows among these), for runs of rows of bounded size."""
    hasher = word_hasher()
    data, offsets = text_buffer(column)
    for a, b in slices(offsets):
        part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if len(part) > SLICE_BYTES:  # a single long row
            found = []
            bounds = cuts(part)
            for x, y in zip(bounds, bounds[1:], strict=False):
                starts, ends, _ = word_bounds(part[x:y], np.array([0, y - x]))
                found.append(hasher(part[x:y], starts, ends, lower))
            words = np.concatenate(found)
            yield a, b, words, np.array([0, len(words)])
        else:
            starts, ends, at = word_bounds(part, own)
            yield a, b, hasher(part, starts, ends, lower) if len(starts) else np.zeros(0, np.uint64), at


def rolled(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words."""
    salts = mixed(np.arange(1, width + 1, dtype=np.uint64))
    n = max(0, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width if n else 0):
            out = mixed(out + (words[k : n + k] ^ salts[k]))
    return out


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each row's shingles; a row with fewer words has its whole sequence as one, or none."""
    step = 1 << 18
    if len(offsets) == 2 and len(words) > 2 * step:
        return [np.unique(np.concatenate([np.unique(rolled(words[k : k + step + width - 1], width)) for k in range(0, len(words) - width + 1, step)]))]
    out = []
    runs = rolled(words, width)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        elif b > a:
            out.append(mixed(rolled(words[a:b], int(b - a)) ^ np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(first row, last row, sorted distinct shingle hashes of each row), for runs of rows of bounded size."""
    for a, b, words, at in hashed_words(column):
        yield a, b, shingle_hashes(words, at, width)


def as_batches(rows: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], type=f.type) for f in schema], schema=schema)
