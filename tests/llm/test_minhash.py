from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quireflow.llm import common, minhash
from quireflow.llm.components import components

from .conftest import by_id, twins


def sets_of(text: str | None, width: int) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset(zip(*[w[k:] for k in range(width)], strict=False)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(texts: dict[int, str | None], width: int, percent: int) -> dict[int, tuple[int, int]]:
    sets = {i: sets_of(t, width) for i, t in texts.items()}
    home = {i: i for i in texts}

    def find(x: int) -> int:
        while home[x] != x:
            x = home[x]
        return x

    ids = sorted(texts)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    home[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(n: int, base_words: int, seed: int) -> dict[int, str]:
    """Copies of one text with a few to many words changed, so some pairs are just under and some just over the limit."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(5000)]
    base = [rng.choice(vocabulary) for _ in range(base_words)]
    out = {}
    for i in range(n):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 6, 8, 10, 14])):
            words[rng.randrange(base_words)] = rng.choice(vocabulary)
        out[i] = " ".join(words)
    return out


@pytest.mark.parametrize(("n", "words", "width"), [(120, 120, 2), (300, 60, 2), (60, 80, 5)])
def test_against_brute_force(spark, n, words, width):
    texts: dict = corpus(n, words, n)
    texts |= {1000 + k: " ".join(random.Random(k).choices("abcdefgh", k=k % 4)) for k in range(40)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    found = by_id(minhash.near_duplicates(df, width=width))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == brute(texts, width, 80)
    assert all(r["kept"] == (i == r["component_id"]) for i, r in found.items())


def test_large_buckets_go_through_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 3)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 400)
    texts = corpus(150, 70, 5)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = by_id(minhash.near_duplicates(df, width=2))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == brute(texts, 2, 80)


@pytest.mark.parametrize("size", [256, 1024, 4096])
def test_words_that_polynomial_hashes_confuse(spark, size):
    df = spark.createDataFrame(list(enumerate(twins(size), 1)), "doc_id long, text string")
    assert {i: (r["component_id"], r["kept"]) for i, r in by_id(minhash.near_duplicates(df, width=2)).items()} == {1: (1, True), 2: (2, True)}


def test_repeated_ids(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (3, "x y z"), (3, "p q r"), (4, "p q r"), (None, "a b c d"), (None, "m n")]
    found = sorted((tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()), key=str)
    assert found == sorted([(5, 3, 5, True), (5, 3, 5, True), (3, 2, 3, True), (3, 2, 3, True), (4, 2, 3, False), (None, 3, 5, False), (None, 1, None, False)], key=str)


def test_long_texts_are_cut_inside(monkeypatch):
    text = " ".join(f"w{k % 70_001}" for k in range(600_000))
    (_, _, (cut,)), = common.shingle_sets(pa.array([text]), 3)
    monkeypatch.setattr(common, "SLICE_BYTES", 1 << 30)
    whole = [s for _, _, s in common.shingle_sets(pa.array([text, "x"]), 3)][0]
    assert len(text) > 1 << 20 and (cut == whole[0]).all()


def test_edges(spark, edge, nothing):
    found = by_id(minhash.near_duplicates(edge, width=2))
    assert [found[k]["n_shingles"] for k in range(7)] == [0, 0, 0, 1, 1, 1, 1]
    assert [found[k]["component_id"] for k in range(7)] == [0, 1, 2, 3, 3, 5, 5]
    assert found[8]["component_id"] == 7
    assert minhash.near_duplicates(nothing).collect() == []


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 2**63, 800, dtype=np.uint64)
    a, b = (np.concatenate([shared, rng.integers(0, 2**63, 100, dtype=np.uint64)]) for _ in range(2))
    same = np.mean(minhash.signature(a, 1024) == minhash.signature(b, 1024))
    assert abs(same - 0.8) < 0.05
    scatter, values = minhash.permutations(8)
    assert (values[-8:] == values[:8]).all() and len(np.unique(scatter)) == len(scatter)


def test_words_and_hashes():
    texts = ["a B\tc\x0bd\x0ce\rf\ng", "", None, "x", " y ", "no break", "AbÉ"]
    data, offsets = common.text_buffer(pa.array(texts))
    starts, ends, at = common.word_bounds(data, offsets)
    words = [[data[starts[k] : ends[k]].tobytes() for k in range(at[i], at[i + 1])] for i in range(len(texts))]
    assert words == [(t or "").encode().split() for t in texts]
    hasher = common.WordHasher()
    lower = hasher(data, starts, ends)
    assert len(set(lower.tolist())) == len(lower) and hasher(*(lambda d, o: (d, *common.word_bounds(d, o)[:2]))(*common.text_buffer(pa.array(["b"]))))[0] == lower[1]


def test_components(spark):
    links = [(5, 4), (4, 3), (9, 8), (7, 7)] + [(k, k + 1) for k in range(100, 140)]
    found = {r["v"]: r["comp"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found[5] == found[4] == found[3] == 3 and found[9] == 8 and found[7] == 7
    assert {found[k] for k in range(100, 141)} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_group_of_copies_makes_links_in_proportion(spark):
    import pandas as pd

    from quireflow.llm.components import extended

    words = [f"w{k}" for k in range(60)]
    part = pd.DataFrame({"id": range(40), "comp": range(40), "text": [" ".join([*words, f"end{i}"]) for i in range(40)]})
    found = minhash.block_links(part, 5, 80)
    assert len(found) == 39  # all 780 pairs are alike
    links = spark.createDataFrame(found, "a long, b long")
    assert {(r["v"], r["comp"]) for r in components(links).collect()} == {(i, 0) for i in range(40)}
    held = components(spark.createDataFrame([(1, 5), (5, 9), (2, 7)], "a long, b long"))
    rows = lambda more: sorted(map(tuple, extended(held, spark.createDataFrame(more, "a long, b long")).select("v", "comp").collect()))
    assert rows([(9, 1)]) == [(1, 1), (2, 2), (5, 1), (7, 2), (9, 1)]
    assert rows([(7, 9), (7, 5), (3, 0), (11, 3)]) == [(0, 0), (1, 1), (2, 1), (3, 0), (5, 1), (7, 1), (9, 1), (11, 0)]


def test_texts_stay_where_they_are(spark, monkeypatch):
    """Only texts that may be in a pair are written again, and no join on ids moves those that are not, also where none is small."""
    import corpus_pipeline

    plans = {}

    def seen(df, name, codec=None):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return common.staged(df, name, codec)

    docs = spark.createDataFrame([(k, " ".join(f"w{k // 2 if k < 20 else k}x{i}" for i in range(80)) + f" end{k}") for k in range(400)], "doc_id long, text string")
    ids = common.staged(spark.range(0, 4000, 10).select(F.col("id").alias("doc_id")), "ids")
    rows = common.sieved(spark.range(4000).select(F.col("id").alias("doc_id")), "doc_id", ids).collect()
    assert all(r["__maybe"] for r in rows if r["doc_id"] % 10 == 0) and sum(r["__maybe"] for r in rows if r["doc_id"] % 10) < 900
    monkeypatch.setattr(minhash, "staged", seen)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert len(corpus_pipeline.without_near_duplicates(spark, docs, "").collect()) == 390
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "hashpartitioning" not in plans["texts"]
