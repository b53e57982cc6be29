"""Chat events as a streaming source: an append-only log with numbered events, read by ranges and acknowledged by commits.

`publish` appends a table of events to a log; each gets the next number, and numbers never change. The source's offset is
the next number to read, so a restart from a checkpoint takes up where the last batch ended, and a batch that failed is
read again as it was. Once Spark commits a batch, `committed.json` says so, and `trim` drops segments that lie before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.batch import placed
from ..operators.commits import CommitLog, drop_all_but

SCHEMA = "seq long, thread string, turn long, role string, text string"
#: Events in a segment, which is one file and one task of a read.
SEGMENT = 50_000


def publish(events: DataFrame, path: str, segment: int = SEGMENT) -> int:
    """Append events (thread, turn, role, text), in the order of turn, then of all they say; how many the log has then."""
    spark, log = events.sparkSession, CommitLog(events.sparkSession, f"{path}/log")
    name = uuid.uuid4().hex
    fields = ["turn", "thread", "role", "text"]
    own = placed(events.select(*[F.col(c).cast("string" if c != "turn" else "long").alias(c) for c in fields]), [F.col(c) for c in fields])
    keyed = own.withColumn("segment", F.floor((F.col("place") - 1) / segment).cast("int"))
    keyed.repartition("segment").sortWithinPartitions("segment", "place").write.partitionBy("segment").parquet(f"{path}/events/{name}")
    n = spark.read.schema("place long").parquet(f"{path}/events/{name}").count()

    def change(_: int, held: dict) -> dict:
        first = held.get("next", 0)
        return {"next": first + n, "parts": [*held.get("parts", []), {"name": name, "first": first, "n": n, "segment": segment}]}

    return log.state(log.commit(change))["next"]


def committed(spark: SparkSession, path: str) -> int:
    fs, where = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return _read_json(fs, f"{where}/committed.json", {"next": 0})["next"]


def trim(spark: SparkSession, path: str) -> int:
    """Drop what was published at once and is read to its end; how many such tables went."""
    log, done = CommitLog(spark, f"{path}/log"), committed(spark, path)
    before = len(log.state().get("parts", []))
    number = log.commit(lambda _, held: held | {"parts": [p for p in held.get("parts", []) if p["first"] + p["n"] > done]})
    kept = log.state(number)["parts"]
    drop_all_but(spark, f"{path}/events", {p["name"] for p in kept})
    return before - len(kept)


def _read_json(fs: pafs.FileSystem, path: str, default: dict) -> dict:
    if fs.get_file_info(path).type != pafs.FileType.File:
        return default
    with fs.open_input_stream(path) as f:
        return json.loads(f.read())


class Range(InputPartition):
    """The events from `low` on and before `high` of one published table's segment; its first event has the number `first`."""

    def __init__(self, folder: str, first: int, low: int, high: int):
        self.folder, self.first, self.low, self.high = folder, first, low, high


class ChatReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def _fs(self) -> tuple[pafs.FileSystem, str]:
        if "://" in self.path or self.path.startswith("file:"):
            return pafs.FileSystem.from_uri(self.path)
        return pafs.LocalFileSystem(), self.path

    def _state(self) -> dict:
        fs, where = self._fs()
        names = [i.base_name for i in fs.get_file_info(pafs.FileSelector(f"{where}/log", allow_not_found=True)) if i.base_name.endswith(".json")]
        return _read_json(fs, f"{where}/log/{max(names)}", {}) if names else {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"next": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"next": self._state().get("next", 0)}

    def partitions(self, start: dict, end: dict) -> Sequence[Range]:
        out = []
        for part in self._state().get("parts", []):
            low, high = max(part["first"], start["next"]), min(part["first"] + part["n"], end["next"])
            while low < high:
                segment = (low - part["first"]) // part["segment"]
                stop = min(high, part["first"] + (segment + 1) * part["segment"])
                out.append(Range(f"events/{part['name']}/segment={segment}", part["first"], low, stop))
                low = stop
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, where = self._fs()
        files = [i.path for i in fs.get_file_info(pafs.FileSelector(f"{where}/{partition.folder}")) if i.path.endswith(".parquet")]
        for path in files:
            with fs.open_input_file(path) as f:
                for batch in pq.ParquetFile(f).iter_batches(batch_size=4096):
                    seq = pc.add(batch.column("place"), partition.first - 1)
                    inside = pc.and_(pc.greater_equal(seq, partition.low), pc.less(seq, partition.high))
                    rows = pa.RecordBatch.from_arrays([seq, *(batch.column(c) for c in ("thread", "turn", "role", "text"))], names=["seq", "thread", "turn", "role", "text"])
                    yield rows.filter(inside)

    def commit(self, end: dict) -> None:
        fs, where = self._fs()
        with fs.open_output_stream(f"{where}/committed.json") as f:
            f.write(json.dumps(end).encode())


class ChatEvents(DataSource):
    """readStream.format("quireflow_chat").option("path", log)"""

    @classmethod
    def name(cls) -> str:
        return "quireflow_chat"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ChatReader:  # noqa: N802
        return ChatReader(self.options["path"])


def chat_events(spark: SparkSession, path: str) -> DataFrame:
    """The stream of a log's events."""
    spark.dataSource.register(ChatEvents)
    return spark.readStream.format("quireflow_chat").option("path", path).load()
