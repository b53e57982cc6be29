from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quireflow.llm import toxicity

from .conftest import by_id, twins


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    even = F.xxhash64("doc_id") % 2 == 0
    model = toxicity.fit(docs, labels.filter(even))
    found = toxicity.severity(docs, model).join(labels.filter(~even).withColumnRenamed("toxic", "truth"), "doc_id").toPandas()
    hit = (found.toxic & (found.truth > 0)).sum()
    # one toxic label in fourteen of this table has no word that tells it, and 200 toxic rows in four languages show few words often
    assert hit / (found.truth > 0).sum() > 0.78
    assert hit / found.toxic.sum() > 0.97
    assert found[found.truth > 0].severity.mean() > found[found.truth == 0].severity.mean() + 0.5


def test_severity_against_brute_force(spark):
    """Each text's features, their weights and both thresholds, term by term."""
    import math
    import re
    from collections import Counter

    from quireflow.llm import common

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    more = spark.createDataFrame([(90_001, " ".join(twins(1024))), (90_002, None), (90_003, "Scum idiot " * 200_000)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(more)
    model = toxicity.fit(docs, labels)
    assert (model.weights > 0).any() and len(model.features) > 5
    weight, hasher = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True)), common.word_hasher()

    def place(word: bytes, beginning: bool) -> int:
        data = np.frombuffer(word, np.uint8)
        h = hasher(data, np.array([0]), np.array([len(data)]))
        return int((common.mixed(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) if beginning else h)[0])

    memo: dict = {}
    texts = {d["doc_id"]: d["text"] for d in docs.collect()}
    for i, r in by_id(toxicity.severity(docs, model)).items():
        text = texts[i]
        held: Counter = Counter()
        for word, n in Counter(re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())).items():
            for part, beginning in [(word, False), *((word[:k], True) for k in toxicity.PREFIX_BYTES if len(word) > k)]:
                key = memo.get((part, beginning))
                key = memo[part, beginning] = place(part, beginning) if key is None else key
                if key in weight:
                    held[key] += n
        score = sum(weight[k] * math.log2(1 + n) for k, n in held.items())
        p = [1 / (1 + math.exp(-min(40, max(-40, score - t)))) for t in model.thresholds]
        assert abs(r["severity"] - sum(p)) < 2e-6 and abs(r["p_toxic"] - p[0]) < 2e-6 and r["grade"] == sum(x >= 0.5 for x in p)


def test_features_speak_for_both_sides(spark):
    rows = [(k, ("kind " if k % 2 else "vile ") + "word " * (k % 7)) for k in range(200)]
    labels = [(k, 1 - k % 2, int(k % 4 > 1)) for k in range(200)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int"))
    assert (model.weights > 0).any() and (model.weights < 0).any()


def test_grades():
    assert toxicity.graded(np.array([False, True, True, True]), np.array([0.9, 0.1, 0.2, 0.3])).tolist() == [0, 1, 1, 2]


def test_labels_may_bring_grades(spark):
    texts = ["calm words", "rude words", "vile words"]
    docs = spark.createDataFrame([(k, texts[k % 3] + f" {k}") for k in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 3 + (5 if k % 3 == 2 else 0)) for k in range(300)], "doc_id long, grade int")
    found = by_id(toxicity.severity(docs, toxicity.fit(docs, labels)))
    assert all(found[k]["severity"] < found[k + 1]["severity"] for k in range(0, 300, 3)) and not found[0]["toxic"] and found[1]["toxic"]


def test_edges(spark, edge, nothing):
    labels = spark.createDataFrame([(k, int(k in (3, 4))) for k in range(12)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(edge, labels)
    found = by_id(toxicity.severity(edge, model))
    assert len(found) == 12 and found[5]["severity"] == found[6]["severity"] and not found[0]["toxic"]
    assert toxicity.severity(nothing, model).collect() == []
    blank = toxicity.fit(edge, labels.filter("toxic = 0"))
    assert toxicity.severity(edge, blank).filter("toxic").count() == 0
    assert toxicity.without_toxic(edge, blank).count() == 12 and toxicity.without_toxic(edge, blank).columns == edge.columns
    assert toxicity.fit(edge, labels.limit(0)).thresholds[0] > 30


def test_ordinal_fit_shares_weights():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 4)) < 0.4
    w, theta = np.array([2.0, 1.0, 0.0, -1.5]), np.array([1.0, 2.5])
    u = rng.random(3000)
    above = 1 / (1 + np.exp(-((x @ w)[:, None] - theta)))
    grades = (u[:, None] < above).sum(axis=1)
    found, cuts = toxicity.ordinal([np.flatnonzero(r) for r in x], [np.ones(r.sum()) for r in x], grades, 4)
    assert np.abs(found - w).max() < 0.35 and np.abs(cuts - theta).max() < 0.35 and cuts[0] < cuts[1]


@pytest.mark.parametrize("p", [[0.1, 0.2, 0.8, 0.9]])
def test_cut(p):
    assert toxicity.best_cut(np.array(p), np.array([False, False, True, True])) == pytest.approx(0.5)


def test_an_id_that_comes_very_often_is_one_row(spark):
    from pyspark.sql import functions as F

    own = spark.range(40).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "you vile rotten thing").otherwise("a calm and kind day").alias("text"))
    docs = own.unionByName(spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a calm and kind day").alias("text")))
    labels = own.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("toxic"))
    assert toxicity.fit_rows(docs, labels, "doc_id", "text").count() == 40
