from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quireflow.operators import ann as A
from quireflow.operators import retrieval as R

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return A.VectorIndex(spark, str(tmp_path_factory.mktemp("ann") / "index")).build(spark.read.parquet(f"{FOLDER}/embeddings.parquet"))


def test_recall_of_all_ids_divisible_by_50(spark, index):
    points = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    questions = points.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("question"), "embedding")
    exact = R.top_k_each(points, questions, 10)
    found = A.recall(index.search_each(questions, 10), exact).agg(F.sum("hits"), F.sum("wanted"), F.count(F.lit(1))).first()
    print("recall at 10:", found[0] / found[1], "of", found[2], "questions,", len(index.held()["centroids"]), "cells,", index.probes(None), "probed")
    assert found[2] == questions.count() and found[0] / found[1] >= 0.9
    every = index.search_each(questions, 10, probes=A.CELLS)
    assert every.select("question", "vec_id", "rank").exceptAll(exact.select("question", "vec_id", "rank")).count() == 0


def test_every_row_is_indexed_and_cells_are_pruned(spark, index, capsys):
    points = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    assert index.points().count() == points.count() == sum(index.held()["counts"].values())
    query = [float(x) for x in points.first()["embedding"]]
    found = index.search(query, 5, probes=2)
    assert found.first()["vec_id"] == points.first()["vec_id"]
    cells = A.nearest(np.array([query]), index.held()["centroids"], 2)[0].tolist()
    assert found.inputFiles() and {int(f.partition("cell=")[2].partition("/")[0]) for f in index.points(cells).select("vec_id").inputFiles()} <= set(range(len(index.held()["centroids"])))
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters" in plan and "cell" in plan.partition("PartitionFilters")[2][:200] and "TakeOrderedAndProject" in plan
    assert index.points(cells).count() == sum(index.held()["counts"].get(c, 0) for c in cells)
    assert [r["vec_id"] for r in index.search(query, 5, {"label": [1, 3]}, A.CELLS).collect()] == [r["vec_id"] for r in R.top_k(points, query, 5, {"label": [1, 3]}, "vec_id").collect()]


def test_hot_cells_nulls_and_small_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(A, "POINTS_AT_ONCE", 7)
    monkeypatch.setattr(A, "QUESTIONS_AT_ONCE", 3)
    same, other = [1.0, 0.0, 0.0], [0.0, 1.0, 0.5]
    rows = [(k, same) for k in range(60)] + [(100 + k, [0.1 * k, 1.0, 0.2]) for k in range(20)] + [(200, None), (201, [0.0, 0.0, 0.0])]
    points = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = A.VectorIndex(spark, str(tmp_path / "one")).build(points, cells=3)
    questions = spark.createDataFrame([(k, same if k % 2 else other) for k in range(10)] + [(99, None)], "question long, embedding array<float>")
    found = index.search_each(questions, 4, probes=3)
    exact = R.top_k_each(points, questions, 4)
    columns = ["question", "vec_id", "rank"]
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, exact.select(*columns).collect()))
    with pytest.raises(FileExistsError):
        A.VectorIndex(spark, str(tmp_path / "one")).build(points.limit(0))
    none = A.VectorIndex(spark, str(tmp_path / "none")).build(points.limit(0))
    assert none.search_each(questions).count() == 0 and none.search(same).count() == 0
    again = A.VectorIndex(spark, str(tmp_path / "one"))
    assert again.search(same, 3).first()["vec_id"] == 0


def test_fit_uses_all_centroids():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.01, (50, 3)) for c in ((1, 0, 0), (0, 1, 0), (0, 0, 1))])
    found = A.fit(x, 3, seed=5)
    assert sorted(np.abs(found).argmax(axis=1).tolist()) == [0, 1, 2]
    assert len(A.fit(x[:2], 9)) == 2


def test_a_pair_of_blocks_holds_few_scores_at_once():
    rng = np.random.default_rng(3)
    side = lambda n, key, vector: pa.table({key: pa.array(rng.permutation(n)), vector: pa.array(list(rng.integers(-2, 3, (n, 4)).astype(np.float32)))})
    p, q = side(4000, "key", "v"), side(3000, "question", "w")
    tracemalloc.start()
    found = R.best_of_blocks(3)(p, q)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90 << 20 and R.POINTS_AT_ONCE * 8 <= R.SCORES_AT_ONCE  # all scores are 96 MB, and were held three times
    v = np.array(p["v"].to_pylist(), float)[np.argsort(p["key"].to_numpy())]
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
    for i in (0, 1500, 2999):
        near = np.round(v @ (np.array(q["w"][i].as_py(), float) / max(1e-30, np.linalg.norm(q["w"][i].as_py()))), 12)
        assert found["key"].to_pylist()[3 * i : 3 * i + 3] == np.argsort(-near, kind="stable")[:3].tolist()
