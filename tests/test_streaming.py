from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from quireflow.streaming import files, threads


def test_files_resume(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()

    def ingest(batch, number):
        seen.extend(r["path"].rpartition("/")[2] for r in batch.select("path").collect())

    def run():
        files.ingest_stream(spark, str(folder), str(tmp_path / "check"), ingest).awaitTermination(60)

    for name in ("a.epub", "b.PDF", "c.txt"):
        (folder / name).write_bytes(b"x")
    run()
    assert sorted(seen) == ["a.epub", "b.PDF"]
    (folder / "d.pdf").write_bytes(b"y")
    run()
    assert sorted(seen) == ["a.epub", "b.PDF", "d.pdf"]


def stream(spark, folder, schema, parts, name, make, mode="append"):
    """Rows of a stream over JSON files, one file to a batch."""
    folder.mkdir()
    for k, rows in enumerate(parts):
        (folder / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows))
        import os

        os.utime(folder / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    query = make(source).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(folder) + "-check").start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_threads(spark, tmp_path):
    parts = [[{"thread": "t", "seq": 0}, {"thread": "t", "seq": 1, "focus_book": "b", "leave": False}], [{"thread": "t", "seq": 2}, {"thread": "t", "seq": 3, "leave": True}, {"thread": "u", "seq": 0}]]
    make = lambda df: threads.thread_stream(df.withColumn("leave", F.coalesce("leave", F.lit(False))))
    rows = stream(spark, tmp_path / "in", "thread string, seq long, focus_book string, leave boolean", parts, "threads", make)
    assert sorted((r["thread"], r["seq"], r["mode"], r["book_id"], r["history_length"]) for r in rows) == [("t", 0, "global", None, 1), ("t", 1, "book", "b", 1), ("t", 2, "book", "b", 2), ("t", 3, "global", None, 1), ("u", 0, "global", None, 1)]


def test_loans_end_by_event_time(spark, tmp_path):
    at = lambda d: dt.datetime(2024, 1, d).isoformat()
    parts = [
        [{"loan": "x", "kind": "checkout", "at": at(1), "due": at(5)}, {"loan": "y", "kind": "checkout", "at": at(1), "due": at(5)}],
        [{"loan": "y", "kind": "return", "at": at(3)}],
        [{"loan": "z", "kind": "checkout", "at": at(9), "due": at(20)}],
        [{"loan": "z", "kind": "return", "at": at(10)}],
    ]
    rows = stream(spark, tmp_path / "in", "loan string, kind string, at timestamp, due timestamp", parts, "loans", threads.loan_stream)
    assert sorted((r["loan"], r["status"]) for r in rows) == [("x", "active"), ("x", "auto-returned"), ("y", "active"), ("y", "returned"), ("z", "active"), ("z", "returned")]


def test_windows(spark, tmp_path):
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m).isoformat()
    parts = [[{"at": at(1, 5), "k": "a"}, {"at": at(1, 50), "k": "a"}], [{"at": at(9, 0), "k": "a"}], [{"at": at(9, 1), "k": "a"}], [{"at": at(1, 1), "k": "a"}, {"at": at(9, 30), "k": "b"}]]
    rows = stream(spark, tmp_path / "in", "at timestamp, k string", parts, "windows", lambda df: threads.event_windows(df, "at", ["k"]))
    assert [(r["window"]["start"].hour, r["events"]) for r in rows] == [(1, 2)]  # the late event is dropped, open windows wait


def test_chat_events_are_neither_lost_nor_repeated(spark, tmp_path):
    import pytest
    from pyspark.errors import StreamingQueryException

    from quireflow.streaming import chat_source as C

    log, seen, broken = str(tmp_path / "log"), [], [True]
    rows = lambda low, high: spark.createDataFrame([(f"t{k % 3}", k, "user", f"m{k}") for k in range(low, high)], "thread string, turn long, role string, text string")

    def take(batch, number):
        got = [(r["seq"], r["text"]) for r in batch.collect()]
        if broken[0] and got and number == 1:
            raise ValueError("lost")
        seen.extend(got)

    def run():
        C.chat_events(spark, log).writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(60)

    assert C.publish(rows(0, 10), log, segment=4) == 10
    run()
    assert sorted(seen) == [(k, f"m{k}") for k in range(10)]
    C.publish(rows(10, 13), log)
    with pytest.raises(StreamingQueryException):
        run()
    C.publish(rows(13, 15), log)
    broken[0] = False
    run()
    run()
    assert sorted(seen) == [(k, f"m{k}") for k in range(15)]
    assert 10 <= C.committed(spark, log) <= 15 and C.trim(spark, log) >= 1
    C.publish(rows(15, 16), log)
    run()
    assert sorted(seen) == [(k, f"m{k}") for k in range(16)]


def test_a_reader_waits_and_forgets(spark, tmp_path):
    from quireflow.streaming.run import ROCKSDB, settings

    at = lambda m: dt.datetime(2024, 1, 1, 12, m % 60).replace(hour=12 + m // 60).isoformat()
    event = lambda seq, minute, **more: {"thread": "t", "seq": seq, "at": at(minute), "leave": False, "more": False} | more
    parts = [
        [event(0, 0, parts=["a", "b", "c", "d"]), event(1, 1, more=True)],
        [event(2, 2), event(3, 3, more=True), event(4, 4, focus_book="x"), event(5, 5, more=True)],
        [event(6, 6, parts=["e", "f"]), event(7, 80, more=True), event(8, 81, parts=["g"]), event(9, 82, leave=True)],
    ]
    with settings(spark, ROCKSDB):
        rows = stream(spark, tmp_path / "in", "thread string, seq long, at timestamp, focus_book string, leave boolean, parts array<string>, more boolean", parts, "reader", lambda df: threads.reading_stream(df, late="1 day"))
    got = [(r["seq"], r["reply"], r["waiting"], r["mode"], r["history_length"]) for r in sorted(rows, key=lambda r: r["seq"])]
    assert got == [(0, "a", 3, "global", 1), (1, "b", 2, "global", 2), (2, None, 2, "global", 3), (3, "c", 1, "global", 4), (4, None, 0, "book", 1), (5, None, 0, "book", 2), (6, "e", 1, "book", 3), (7, None, 0, "book", 4), (8, "g", 0, "book", 5), (9, None, 0, "global", 1)]
