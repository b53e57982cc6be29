from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quireflow.llm import jaccard_join as J
from quireflow.llm import minhash
from quireflow.llm.common import mixed, shingle_sets

from .conftest import by_id
from .test_minhash import brute, corpus


def found(spark, texts: dict, width: int, percent: int) -> dict:
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    return {i: tuple(r)[1:] for i, r in by_id(J.linked(df, width=width, percent=percent)).items()}


@pytest.mark.parametrize(("n", "words", "width", "percent"), [(200, 150, 3, 90), (150, 400, 3, 90), (100, 60, 1, 70)])
def test_against_brute_force(spark, n, words, width, percent):
    texts: dict = corpus(n, words, n + words)
    texts |= {1000 + k: " ".join(random.Random(k).choices("abcdefgh", k=k % 4)) for k in range(40)}
    texts |= {2000 + k: texts[k] for k in range(20)} | {3000: None, 3001: "", 3002: " \t"}
    assert found(spark, texts, width, percent) == brute(texts, width, percent)


def test_large_buckets_go_through_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "SMALL", 3)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 400)
    texts = corpus(150, 120, 9)
    assert found(spark, texts, 3, 85) == brute(texts, 3, 85)


def test_filters_let_every_link_through(spark):
    """Pairs of sets that are alike: they share an n-gram of both prefixes, and there no filter holds them back."""
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 5, 1 << J.COUNT_BITS).astype(np.uint8)
    rows = []
    for k in range(300):
        n = int(rng.integers(1, 200))
        x = np.unique(mixed(rng.integers(1, 1 << 40, n).astype(np.uint64)))
        keep = x[rng.random(len(x)) < rng.choice([1.0, 0.97, 0.9])]
        y = np.unique(np.concatenate([keep, mixed(rng.integers(1, 1 << 40, int(rng.integers(0, 1 + n // 20))).astype(np.uint64))]))
        if not len(y):
            continue
        both = len(np.intersect1d(x, y))
        tokens = [J.ordered(s, counts) for s in (x, y)]
        size = [len(s) - J.required(len(s), 90) + 1 for s in (x, y)]
        parts = [J.suffix_parts(t, s) for t, s in zip(tokens, size, strict=True)]
        hits = [(i, j) for i, a in enumerate(tokens[0][: size[0]].tolist()) for j, b in enumerate(tokens[1][: size[1]].tolist()) if a == b]
        alike = bool(minhash.alike(both, len(x), len(y), 90))
        assert not alike or hits
        rows += [(k, alike, (len(x), i, i, int(parts[0][i])), (len(y), j, j, int(parts[1][j]))) for i, j in hits]
    side = "struct<n: bigint, pos: bigint, live: bigint, parts: bigint>"
    df = spark.createDataFrame(rows, f"k int, alike boolean, p {side}, q {side}").withColumn("ok", J.possible("p", "q", 90)).cache()
    assert df.filter("alike AND NOT ok").count() == 0
    assert df.filter("NOT alike AND NOT ok").count() > 0
    assert df.filter("p.n > 0").select(J.band(F.col("p.n"), 90).alias("b")).filter("b < 0").count() == 0


def test_frequencies_are_sums_over_all_tasks(spark):
    rows = [(" ".join(f"w{j}" for j in range(k % 40)),) for k in range(300)]
    found = J.frequencies(spark.createDataFrame(rows, "text string").repartition(5), "text", 3)
    want = np.zeros(1 << J.COUNT_BITS, np.int64)
    for (text,) in rows:
        for _, _, sets in shingle_sets(pa.array([text]), 3):
            np.add.at(want, J.bucket_of(sets[0]), 1)
    assert (found == np.minimum(want, 255)).all() and found.max() == 255


def test_suffix_parts_count_what_follows():
    tokens = mixed(np.arange(40, dtype=np.uint64))
    parts = J.suffix_parts(tokens, 5).view(np.uint8).reshape(5, 8)
    for i in range(5):
        assert parts[i].tolist() == np.bincount((mixed(tokens[i + 1 :]) >> np.uint64(61)).astype(int), minlength=8).tolist()


def test_repeated_ids(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (3, "x y z"), (3, "p q r"), (4, "p q r"), (None, "a b c d"), (None, "m n")]
    out = sorted((tuple(r) for r in J.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert out == sorted([(5, 2, 5), (5, 2, 5), (3, 1, 3), (3, 1, 3), (4, 1, 3), (None, 2, 5), (None, 1, None)], key=str)


def test_edges(spark, edge, nothing):
    out = by_id(J.linked(edge))
    assert [out[k]["component_id"] for k in range(7)] == [0, 1, 2, 3, 3, 5, 5] and [out[k]["n_shingles"] for k in (0, 1, 2, 3)] == [0, 0, 0, 1]
    assert out[8]["component_id"] == 7  # the long text and the one with a letter more
    assert J.linked(nothing).count() == 0
