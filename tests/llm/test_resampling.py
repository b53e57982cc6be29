from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quireflow.llm import resampling as R

from .conftest import by_id

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    raw = (text or "").encode()
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in raw))


def buckets(text: str | None, most: int, size: int) -> list[int]:
    w = words(text)
    return [zlib.crc32(b" ".join(w[i : i + n])) % size for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def brute(docs: dict, target: list, most: int, size: int, least: int, percent: int) -> dict:
    s = Counter(b for t in docs.values() for b in buckets(t, most, size))
    t = Counter(b for x in target for b in buckets(x, most, size))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + size) / ((s[b] + 1) * (all_t + size)))) for b in range(size)]
    rows = {}
    for i, text in docs.items():
        own = buckets(text, most, size)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        rows[i] = [len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    fit = sorted((i for i in docs if len(words(docs[i])) >= least), key=lambda i: (-rows[i][2], i))
    for k, i in enumerate(fit[: len(fit) * percent // 100], 1):
        rows[i][3] = k
    return {i: tuple(r) for i, r in rows.items()}


@pytest.mark.parametrize("most", [1, 3])
def test_against_brute_force(spark, most):
    rng = random.Random(most)
    vocabulary = [f"w{k}" for k in range(80)] + ["Émile", "中文", "x" * 40, "A1"]
    docs: dict = {k: " ".join(rng.choices(vocabulary, k=rng.randrange(60))) for k in range(300)}
    docs |= {1000: None, 1001: "", 1002: " .,-! ", 1003: "One-Two_three\x7ffour"}
    target = [" ".join(rng.choices(vocabulary[:20], k=30)) for _ in range(20)] + [None]
    found = by_id(R.resampled(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5), spark.createDataFrame([(x,) for x in target], "text string"), most=most, buckets=997))
    assert {i: tuple(r)[1:] for i, r in found.items()} == brute(docs, target, most, 997, 20, 10)


def test_crcs_of_runs_follow_from_those_of_words():
    parts = [b"one", b"", b"\xc3\xa9t\xc3\xa9", b"z" * 70_000, b"0"]
    crcs = np.array([zlib.crc32(p) for p in parts], np.uint32)
    size = np.array([len(p) for p in parts])
    runs = R.run_crcs(crcs, size, 4)
    assert [r.tolist() for r in runs] == [[zlib.crc32(b" ".join(parts[i : i + n])) for i in range(len(parts) - n + 1)] for n in range(1, 5)]
    assert len(R.run_crcs(crcs[:1], size[:1], 3)) == 1
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum(size)
    assert R.word_crcs(data, ends - size, ends).tolist() == crcs.tolist()


def test_long_texts_are_read_by_segments(monkeypatch):
    text = " ".join(f"W{k % 7001}" for k in range(300_000))
    whole = [buckets(text, 2, 10_000)]
    (_, n, row, found), *more = R.bucketed(pa.array([text]), 2, 10_000)
    assert not more and n.tolist() == [300_000] and found.tolist() == whole[0] and not row.any()


def test_edges(spark, edge, nothing):
    found = by_id(R.resampled(edge, edge.limit(0)))
    assert [found[k]["n_features"] for k in (0, 1, 2, 3, 5)] == [0, 0, 0, 1, 2] and found[0]["weight"] == 0
    assert sorted(r["rank"] for r in found.values() if r["rank"]) == []  # three texts of 20 words, a tenth of them
    assert R.resampled(nothing, nothing).count() == 0
    many = R.resampled(edge, edge, percent=100)
    assert sorted(r["rank"] for r in many.collect() if r["rank"]) == [1, 2, 3]


def test_repeated_and_missing_ids(spark):
    text = "a b c d e f g h i j k l m n o p q r s t"
    rows = [(1, text), (1, text), (None, text), (None, text), (2, text)]
    found = R.resampled(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "text string"), percent=80).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == [1, 2, 3, 4] and len(found) == 5
    assert len({r["score"] for r in found if r["doc_id"] is None}) == 1
