"""Approximate search: an inverted file of vectors. Each lies in the cell of its nearest centroid, and a search reads few cells.

Centroids are fitted on a bounded sample; every vector is indexed. The points are a table partitioned by cell, so the
cells that a question doesn't probe aren't opened. Probing all cells is exact.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.filters import matching
from ..staging import files_of, read_text, write_new
from .retrieval import POINTS_AT_ONCE, QUESTIONS_AT_ONCE, best_of_blocks, top_k

#: Rows that centroids are fitted on at most, cells at most, and rounds of the fit.
SAMPLE, CELLS, ROUNDS = 32_768, 4096, 8
#: The recall that the number of cells to probe is chosen for.
RECALL = 0.97


def units(values: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(values, axis=1, keepdims=True)
    return np.divide(values, size, out=np.zeros_like(values), where=size > 0)


def fit(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Centroids by spherical k-means: each round moves a centroid to the direction of the vectors nearest to it.

    A centroid that is nearest to none takes the place of the vector that is farthest from its own.
    """
    x = units(np.asarray(sample, np.float64))
    rng = np.random.default_rng(seed)
    found = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        score = x @ found.T
        near = score.argmax(axis=1)
        total = np.zeros_like(found)
        np.add.at(total, near, x)
        lost = np.flatnonzero(np.bincount(near, minlength=len(found)) == 0)
        total[lost] = x[np.argsort(score.max(axis=1), kind="stable")[: len(lost)]]
        found = units(total)
    return found


def nearest(vectors: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest cells of each vector, nearest first."""
    score = units(vectors) @ centroids.T
    if n >= score.shape[1]:
        return np.argsort(-score, axis=1, kind="stable")
    some = np.argpartition(-score, n - 1, axis=1)[:, :n]
    order = np.argsort(-np.take_along_axis(score, some, axis=1), axis=1, kind="stable")
    return np.take_along_axis(some, order, axis=1)


def probes_for(sample: np.ndarray, centroids: np.ndarray, recall: float, k: int = 10, questions: int = 512, seed: int = 1) -> int:
    """The least number of cells that hold so large a share of the k nearest neighbours within the sample, themselves left out.

    Vectors in clear clusters need few cells, those without structure up to half of them.
    """
    x = units(np.asarray(sample, np.float64))
    if len(x) <= k:
        return len(centroids)
    asked = np.random.default_rng(seed).choice(len(x), min(questions, len(x)), replace=False)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    best = np.argpartition(-score, k - 1, axis=1)[:, :k]
    cell = nearest(x, centroids, 1)[:, 0]
    order = nearest(x[asked], centroids, len(centroids))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)  # in which turn a question probes a cell
    turns = np.sort(np.take_along_axis(place, cell[best], axis=1).ravel())
    return int(turns[math.ceil(recall * len(turns)) - 1]) + 1


def rows_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def celled(points: DataFrame, centroids: np.ndarray, probes: int, vector: str = "embedding") -> DataFrame:
    """Rows with `cell`, one for each of the `probes` nearest cells; rows without a vector have none and go."""
    kept = points.filter(F.col(vector).isNotNull())
    where = kept.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = nearest(rows_of(batch.column(where)), centroids, probes)
                row = np.repeat(np.arange(batch.num_rows), cells.shape[1])
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in batch.columns), pa.array(cells.ravel().astype(np.int32))], names=[*batch.schema.names, "cell"])

    return kept.mapInArrow(run, kept.select("*", F.lit(0).alias("cell")).schema)


class VectorIndex:
    """An inverted file under a path: `points`, partitioned by cell, and `index.json` with centroids and sizes of cells."""

    def __init__(self, spark: SparkSession, path: str, key: str | tuple[str, ...] = "vec_id", vector: str = "embedding"):
        """key has one column or more; for a table of questions it must be one of integers."""
        self.spark, self.path, self.vector = spark, path.rstrip("/"), vector
        self.keys = (key,) if isinstance(key, str) else tuple(key)
        self.key = self.keys[0]
        self._held: dict | None = None

    def build(self, points: DataFrame, cells: int | None = None, sample_rows: int = SAMPLE, recall: float = RECALL) -> VectorIndex:
        """Index every row with a vector. Without `cells`, their number is the root of the number of rows, CELLS at most.

        The sample is of rows whose keys hash low, of all partitions alike; its size is a bound. Centroids come from it, and
        how many cells a search probes: as many as give the recall within the sample.
        """
        full = points.filter(F.col(self.vector).isNotNull())
        n = full.count()
        share = min(1.0, 1.2 * sample_rows / max(1, n))
        drawn = full.filter(F.pmod(F.xxhash64(*self.keys), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(self.vector).limit(sample_rows).toArrow()
        sample = rows_of(drawn[self.vector].combine_chunks()) if drawn.num_rows else np.zeros((0, 1))
        centroids = fit(sample, cells or min(CELLS, max(1, math.isqrt(n)))) if len(sample) else np.zeros((0, 1))
        if n:
            celled(points, centroids, 1, self.vector).repartition("cell", F.pmod(F.xxhash64(*self.keys), F.lit(8))).sortWithinPartitions("cell").write.partitionBy("cell").parquet(f"{self.path}/points")
            counts = {str(r["cell"]): r["n"] for r in self.spark.read.parquet(f"{self.path}/points").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # CELLS rows at most
        else:
            counts = {}
        schema = json.loads(points.select("*", F.lit(0).alias("cell")).schema.json())
        wanted = probes_for(sample, centroids, recall) if len(sample) else 0
        if not write_new(self.spark, f"{self.path}/index.json", json.dumps({"centroids": centroids.tolist(), "probes": wanted, "counts": counts, "schema": schema})):
            raise FileExistsError(f"{self.path} holds an index already")
        return self

    def exists(self) -> bool:
        fs, path = files_of(self.spark, self.path)
        return fs.exists(path(f"{self.path}/index.json"))

    def held(self) -> dict:
        if self._held is None:
            found = json.loads(read_text(self.spark, f"{self.path}/index.json"))
            self._held = found | {"centroids": np.asarray(found["centroids"], np.float64), "counts": {int(k): v for k, v in found["counts"].items()}}
        return self._held

    def probes(self, probes: int | None) -> int:
        return min(len(self.held()["centroids"]), probes or self.held()["probes"])

    def points(self, cells: list[int] | None = None) -> DataFrame:
        """The indexed rows, or those of some cells: the folders of the others aren't read."""
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(self.held()["schema"])
        if not self.held()["counts"]:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/points")
        return rows if cells is None else rows.filter(F.col("cell").isin(*cells))

    def search(self, query: list[float], k: int = 10, filters: dict | None = None, probes: int | None = None) -> DataFrame:
        """The k best points that match the filters, of the cells nearest to the query; ties by key."""
        centroids = self.held()["centroids"]
        if not len(centroids):
            return top_k(self.points(), query, k, filters, self.keys, self.vector).drop("cell")
        cells = nearest(np.asarray([query], np.float64), centroids, self.probes(probes))[0].tolist()
        return top_k(self.points(cells), query, k, filters, self.keys, self.vector).drop("cell")

    def search_each(self, questions: DataFrame, k: int = 10, filters: dict | None = None, probes: int | None = None) -> DataFrame:
        """(question, key, score, rank) for a table of questions (question, vector): each goes to its nearest cells only.

        A cell's points and its questions are dealt into blocks by the cell's size, so that a cell with a third of all
        points is as many products of matrices as it needs. A question goes to `probes` cells, not to all blocks of points.
        """
        centroids, counts, n = self.held()["centroids"], self.held()["counts"], self.probes(probes)
        if not counts:
            return self.spark.createDataFrame([], f"question long, {self.key} long, score double, rank int")
        sizes = self.spark.createDataFrame([(c, -(-m // POINTS_AT_ONCE)) for c, m in counts.items()], "cell int, blocks int")  # CELLS rows at most
        p = matching(self.points(), filters).select(F.col(self.key).cast("long").alias("key"), F.col(self.vector).cast("array<double>").alias("v"), "cell").join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        asked = celled(questions.select(F.col("question").cast("long").alias("question"), self.vector), centroids, n, self.vector)
        loads = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUESTIONS_AT_ONCE).cast("int").alias("q_blocks"))
        q = asked.join(F.broadcast(loads), "cell").join(F.broadcast(sizes), "cell")  # CELLS rows at most
        q = q.select("question", F.col(self.vector).cast("array<double>").alias("w"), "cell", F.pmod(F.xxhash64("question"), F.col("q_blocks")).cast("int").alias("q_block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        p = p.join(F.broadcast(loads), "cell").withColumn("q_block", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
        found = p.select("cell", "block", "q_block", "key", "v").groupBy("cell", "block", "q_block").cogroup(q.groupBy("cell", "block", "q_block")).applyInArrow(best_of_blocks(k), "question long, key long, score double")
        rank = F.row_number().over(Window.partitionBy("question").orderBy(F.round("score", 12).desc(), "key"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k).withColumnRenamed("key", self.key)


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id") -> DataFrame:
    """(question, wanted, hits): how many of a question's exact neighbours an approximate search found."""
    both = exact.select("question", key).join(found.select("question", key, F.lit(1).alias("hit")), ["question", key], "left")
    return both.groupBy("question").agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("hits"))
