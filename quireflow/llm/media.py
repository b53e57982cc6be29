"""Media columns: payloads as lossless grey images in archives, read back by a Spark data source that plans byte ranges.

The writer puts each payload into a PNG image of 8-bit grey samples, 64 to a row, and the images into ZIP archives, one
after another in each task. The reader `archive_members` lists the archives of a folder, cuts them into byte ranges, and
gives each range to a task: it reads the archive's directory, takes the members that begin in its range, and streams
their payloads as Arrow batches. A member whose bytes can't be read or don't match its checksum is tried again by its
offset, alone; when all tries fail it comes as a row with an error and no payload, and the others are unaffected.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .common import as_batches, fresh_path, short_batches

WIDTH = 64
#: An archive is closed, and the next one begun, at so many bytes; the least range that one task reads; about the most ranges.
#: A range reads its archive's whole directory, so an archive has two ranges, not many.
ARCHIVE_BYTES, RANGE_BYTES, RANGES = 64 << 20, 32 << 20, 50_000
#: Payload bytes in a batch that goes to Spark.
BATCH_BYTES = 4 << 20
RETRIES, WAIT_S = 3, 0.05
_SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value: the PNG signature


def filesystem(uri: str):
    """The file system of a URI or a plain path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def padded(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of the row width."""
    return raw + bytes(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


#: Rows of samples that are filtered and compressed at once, so a long payload isn't held several times.
ROWS_AT_ONCE = 1 << 14


def to_image(raw: bytes) -> bytes:
    """A grey PNG whose samples are the padded payload; a text chunk has the unpadded length."""
    size = max(1, -(-len(raw) // WIDTH))
    view, deflate, data = memoryview(raw), zlib.compressobj(1), []
    for first in range(0, size, ROWS_AT_ONCE):
        n = min(ROWS_AT_ONCE, size - first)
        part = np.frombuffer(view[first * WIDTH : (first + n) * WIDTH], np.uint8)
        rows = np.zeros((n, WIDTH + 1), np.uint8)
        rows[:, 1:] = np.pad(part, (0, n * WIDTH - len(part))).reshape(n, WIDTH)
        data.append(deflate.compress(rows.tobytes()))
    data.append(deflate.flush())

    def chunk(kind: bytes, body: bytes) -> bytes:
        return b"".join((struct.pack(">I", len(body)), kind, body, struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))))

    head = struct.pack(">IIBBBBB", WIDTH, size, 8, 0, 0, 0, 0)
    return b"".join((_SIGNATURE, chunk(b"IHDR", head), chunk(b"tEXt", b"Length\0%d" % len(raw)), chunk(b"IDAT", b"".join(data)), chunk(b"IEND", b"")))


def from_image(image: bytes) -> tuple[bytes, int]:
    """The padded payload and the unpadded length of an image that to_image() made."""
    if image[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, length, view = 8, 0, memoryview(image)
    inflate, held, out = zlib.decompressobj(), b"", []
    while at < len(image):
        size, kind = struct.unpack_from(">I4s", image, at)
        body = view[at + 8 : at + 8 + size]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", image, at + 8 + size)[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"tEXt":
            length = int(bytes(body).partition(b"\0")[2])
        elif kind == b"IDAT":
            for k in range(0, len(body), 1 << 20):
                held += inflate.decompress(body[k : k + (1 << 20)])
                n = len(held) // (WIDTH + 1)
                rows = np.frombuffer(held, np.uint8, n * (WIDTH + 1)).reshape(n, WIDTH + 1)
                if rows[:, 0].any():
                    raise ValueError("a row filter that the writer never uses")
                out.append(rows[:, 1:].tobytes())
                held = held[n * (WIDTH + 1) :]
        at += size + 12
    if held or not inflate.eof:
        raise ValueError("the image ends inside a row")
    return b"".join(out), length


def feature(payload: bytes) -> str:
    """Mean, deviation and byte entropy of the samples, to three places."""
    samples, counts = np.frombuffer(payload, np.uint8), np.zeros(256)
    for k in range(0, len(samples), 1 << 20):  # counting widens what it counts
        counts += np.bincount(samples[k : k + (1 << 20)], minlength=256)
    share, values = counts / len(payload), np.arange(256)
    mean = float(share @ values)
    deviation = float(np.sqrt(share @ (values - mean) ** 2))
    held = share[share > 0]
    return f"mean={mean:.3f};deviation={deviation:.3f};entropy={abs(float(-(held * np.log2(held)).sum())):.3f}"


def write_archives(items: DataFrame, id_col: str, text_col: str, folder: str) -> int:
    """Write every row's text as an image into archives in folder, and return how many.

    A null text counts as empty. A task writes under names of its own attempt and renames them when it is done, so a task
    that is run again replaces its archives by equal ones; for that, items must come in the same order again, as a scan
    of files does.
    """
    filesystem(folder)[0].create_dir(filesystem(folder)[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, top = filesystem(folder)
        done: list[tuple[str, str]] = []
        members, archive, stream = 0, None, None

        def close() -> None:
            nonlocal archive, stream
            if archive is not None:
                archive.close()
                stream.close()
                archive = stream = None

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if archive is not None and archive.start_dir > ARCHIVE_BYTES:
                    close()
                if archive is None:
                    name = f"part-{task.partitionId():06d}-{len(done):05d}.zip"
                    done.append((f"{top}/.{task.taskAttemptId()}-{name}", f"{top}/{name}"))
                    stream = fs.open_output_stream(done[-1][0])
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                archive.writestr(zipfile.ZipInfo(f"{members}-{key}.png"), to_image((text or "").encode()))
                members += 1
        close()
        for here, there in done:
            if fs.get_file_info(there).is_file:  # from an attempt whose executor was lost
                fs.delete_file(there)
            fs.move(here, there)
        yield pa.RecordBatch.from_pydict({"members": pa.array([members], pa.int64())})

    short_batches(items.sparkSession)
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "members long")
    return rows.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    end: int


_MEMBER = pa.schema([("archive", pa.string()), ("name", pa.string()), ("offset", pa.int64()), ("payload", pa.binary()), ("tries", pa.int32()), ("error", pa.string())])


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.retries = int(options.get("retries", RETRIES))

    def partitions(self) -> list[ByteRange]:
        from pyarrow.fs import FileSelector

        fs, top = filesystem(self.folder)
        files = sorted((f for f in fs.get_file_info(FileSelector(top)) if f.is_file and f.base_name.endswith(".zip") and f.base_name[0] not in "._"), key=lambda f: f.path)
        step = max(self.range_bytes, sum(f.size for f in files) // RANGES)
        ranges = [ByteRange(f.path, a, min(a + step, f.size)) for f in files for a in range(0, f.size, step)]
        return ranges or [ByteRange("", 0, 0)]

    def member(self, fs, stream, info: zipfile.ZipInfo) -> bytes:
        """The bytes of the member at its offset, checked against the directory."""
        stream.seek(info.header_offset)
        head = stream.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("no member begins here")
        name, extra = struct.unpack_from("<HH", head, 26)
        stream.seek(info.header_offset + 30 + name + extra)
        found = stream.read(info.compress_size)
        if info.compress_type == zipfile.ZIP_DEFLATED:
            found = zlib.decompress(found, -15)
        if len(found) != info.file_size or zlib.crc32(found) != info.CRC:
            raise ValueError("the bytes don't match the directory")
        return found

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.end:
            return
        fs, _ = filesystem(self.folder)
        rows, held = [], 0
        with fs.open_input_file(partition.archive) as shared:
            infos = [i for i in zipfile.ZipFile(shared).infolist() if partition.start <= i.header_offset < partition.end]
            for info in infos:
                payload = error = None
                for tries in itertools.count(1):
                    try:
                        if tries == 1:
                            payload = self.member(fs, shared, info)
                        else:  # a stream of its own, in case the shared one is what failed
                            with fs.open_input_file(partition.archive) as own:
                                payload = self.member(fs, own, info)
                        error = None
                    except (OSError, ValueError, zlib.error) as e:
                        error = f"{type(e).__name__}: {e}"
                        if tries <= self.retries:
                            time.sleep(WAIT_S * 2**tries)
                            continue
                    break
                rows.append((partition.archive, info.filename, info.header_offset, payload, tries, error))
                held += len(payload or b"")
                if held >= BATCH_BYTES or len(rows) >= 512:
                    yield as_batches(dict(zip(_MEMBER.names, zip(*rows, strict=True), strict=True)), _MEMBER)
                    rows, held = [], 0
        if rows:
            yield as_batches(dict(zip(_MEMBER.names, zip(*rows, strict=True), strict=True)), _MEMBER)


class ArchiveMembers(DataSource):
    """`spark.read.format("archive_members").load(folder)`: a row for each member of each ZIP archive of a folder."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "archive string, name string, offset long, payload binary, tries int, error string"

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def members(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES, retries: int = RETRIES) -> DataFrame:
    spark.dataSource.register(ArchiveMembers)
    return spark.read.format("archive_members").option("rangeBytes", range_bytes).option("retries", retries).load(folder)


def decoded(found: DataFrame) -> DataFrame:
    """(id, n_bytes, payload, media_bytes, media_sha256, feature) of members that are images of write_archives()."""
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                payload, n = from_image(image)
                key = name.removesuffix(".png").partition("-")[2]
                rows.append((None if key == "None" else int(key), n, payload, len(image), hashlib.sha256(image).hexdigest(), feature(payload)))
            yield as_batches(dict(zip(schema.names, zip(*rows, strict=True) if rows else [[]] * len(schema), strict=True)), schema)

    return found.select("name", "payload").mapInArrow(run, "id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, feature string")


def as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """The rows of decoded() for docs, after a round through archives in folder (by default a new shared one).

    Null and empty texts are one row of zero samples; equal texts, also in repeated rows, give equal media. An unreadable
    member stops the query, since its row would be lost. An empty table gives an empty result. Only the two named columns
    are read, so others may have any names.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "archives")
    write_archives(docs, id_col, text_col, folder)
    found = members(spark, folder).withColumn("payload", F.when(F.col("error").isNull(), F.col("payload")).otherwise(F.raise_error(F.concat_ws(" ", "archive", "name", "error")).cast("binary")))
    return decoded(found).withColumnRenamed("id", id_col)
