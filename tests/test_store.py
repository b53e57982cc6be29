from __future__ import annotations

import threading

import pytest

from quireflow.operators import commits
from quireflow.operators import store as S
from quireflow.operators.store import Collection

POINTS = "book_id string, chunk_index int, content string, is_metadata boolean, tags array<string>"


@pytest.fixture
def store(spark, tmp_path):
    return Collection(spark, str(tmp_path / "points"))


def rows(spark, books, n, text=""):
    return spark.createDataFrame([(b, k, f"{b}{k}{text}", False, [f"tag-{b}", "all"] if k else None) for b in books for k in range(n)], POINTS)


def held(store, **how):
    return {r["book_id"]: r["count"] for r in store.read(**how).groupBy("book_id").count().collect()}


def test_writes_merge_when_read(spark, store, tmp_path):
    assert store.read().count() == 0 and store.delete("a") == 0 and store.version() == 0 and store.files().count() == 0
    assert store.upsert(rows(spark, "abcdefgh", 3)) == 1
    size = lambda: {p.name: sum(f.stat().st_size for f in p.rglob("*.parquet")) for p in (tmp_path / "points" / "data").iterdir()}
    before = size()
    assert store.upsert(rows(spark, "a", 5, "!")) == 2
    assert held(store) == dict.fromkeys("bcdefgh", 3) | {"a": 5}
    assert before.items() <= size().items() and store.files(books=["h"]).agg({"points": "sum"}).first()[0] < 30  # what was there is as it was
    assert {r["content"] for r in store.read(books=["a"]).collect()} == {f"a{k}!" for k in range(5)}
    assert store.delete("b") == 3 and store.delete("b") == 0 and held(store) == dict.fromkeys("cdefgh", 3) | {"a": 5}
    store.upsert(rows(spark, "b", 1))
    assert held(store)["b"] == 1 and store.compact() and not store.compact()
    assert held(store) == dict.fromkeys("cdefgh", 3) | {"a": 5, "b": 1} and len(store.deltas()) == 1
    store.upsert(rows(spark, "c", 4))
    store.vacuum(1)
    assert held(store) == dict.fromkeys("defgh", 3) | {"a": 5, "b": 1, "c": 4} and store.versions() == [6]
    assert {p.name for p in (tmp_path / "points" / "data").iterdir()} == set(store.deltas())


def test_a_write_that_failed_is_not_there(spark, store):
    store.upsert(rows(spark, "a", 2))
    store._write("lost", rows(spark, "z", 9))
    assert held(store) == {"a": 2}


def test_two_writers_at_once(spark, store, monkeypatch):
    store.upsert(rows(spark, "ab", 2))
    other, real = Collection(spark, store.path), commits.write_new

    def late(spark_, path, text):
        if threading.current_thread() is threading.main_thread() and not late.done:
            late.done = True
            other.upsert(rows(spark, "a", 7))  # takes the number that this writer is about to take
        return real(spark_, path, text)

    late.done = False
    monkeypatch.setattr(commits, "write_new", late)
    assert store.upsert(rows(spark, "b", 5)) == 3
    assert held(store) == {"a": 7, "b": 5} and store.versions() == [1, 2, 3]
    late.done = False
    assert store.compact()  # a write comes in between
    assert held(store) == {"a": 7, "b": 5}
    monkeypatch.setattr(commits, "write_new", real)
    both = [threading.Thread(target=Collection(spark, store.path).upsert, args=(rows(spark, b, 3),)) for b in "cdef"]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert held(store) == {"a": 7, "b": 5} | dict.fromkeys("cdef", 3)
    monkeypatch.setattr(commits, "write_new", lambda *_: False)
    with pytest.raises(S.Conflict):
        store.upsert(rows(spark, "x", 1))


def test_deltas_are_folded(spark, store, monkeypatch):
    monkeypatch.setattr(Collection, "COMPACT", 3)
    for k in range(6):
        store.upsert(rows(spark, f"a{k}"[1:], k + 1))
    assert len(store.deltas()) <= 3 and held(store) == {str(k): k + 1 for k in range(6)}


def test_lookups_open_few_files(spark, store):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.upsert(rows(spark, [f"b{k:03d}" for k in range(200)], 3))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    every = store.files().count()
    assert every >= 4 and store.files(books=["b100"]).count() == 1 and store.files(books=["zzz"]).count() == 0
    assert len(store.read(books=["b100"]).inputFiles()) == 1 and held(store, books=["b100", "b001"]) == {"b100": 3, "b001": 3}
    assert 1 <= store.files(tags=["tag-b150"]).count() < every and store.files(tags=["all"]).count() == every
    assert held(store, tags=["tag-b150"]) == {"b150": 2} and held(store, tags=["none"]) == {}
    assert held(store, books=["b150"], tags=["tag-b150", "x"]) == {"b150": 2}
    assert [r["content"] for r in S.scroll(store.read(books=["b007"]), "b007", 2, 1).collect()] == ["b0071", "b0072"]
