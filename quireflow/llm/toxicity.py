"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

P(grade >= k) = sigmoid(w . x - threshold_k), with one w for all thresholds, which rise with k. x has log2(1 + n) for each
word and word beginning that a text holds n times. All features that tell something about the label, for or against it,
take part, however many these are; the rows of the fit are what bounds them.

Labels with a column `grade` (0 to 2) are fitted as they are. Labels that only say toxic or not are graded by a second
reader that never saw them: the labelled rows are split in halves, each half gives a list of features that come with toxic
rows, and a toxic row's grade is 2 if it holds more of the other half's list than the median toxic row does, else 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, as_batches, cuts, mixed, short_batches, slices, staged, text_buffer, word_bounds, word_hasher

#: The fit reads at most so many labelled rows, the first by a hash of their id.
FIT_ROWS = 8192
#: A feature needs so many rows, and so many times the odds of the corpus, for toxic or against it; that keeps out words that
#: only tell the language in which toxic rows happen to be many. CHANCE: of all features that are looked at, so many may pass by chance.
LEAST_ROWS, ODDS_FOR, ODDS_AGAINST, CHANCE = 5, 32.0, 8.0, 0.1
#: Beginnings of words that count as features, in bytes: words that share a root are often too rare one by one.
PREFIX_BYTES = (4, 5, 6, 7)
GRADES = 3
STEPS, RATE, RIDGE = 400, 0.1, 1e-4

_BREAKS = np.ones(128, bool)
_BREAKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
_BREAKS = np.concatenate([_BREAKS, np.zeros(128, bool)])


@dataclass
class OrdinalModel:
    """Sorted hashes of features, their shared weights, the thresholds between grades, and P(grade >= 1) from which a text is toxic."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    toxic_from: float = 0.5

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of each score."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))


def found_in(part: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each word of a slice's rows and of the beginnings of longer words, repeats included."""
    starts, ends, at = word_bounds(part, own, _BREAKS)
    row = np.repeat(np.arange(len(own) - 1, dtype=np.int64), np.diff(at))
    if not len(starts):
        return row, np.zeros(0, np.uint64)
    hasher = word_hasher()
    rows, found = [row], [hasher(part, starts, ends)]
    for n in PREFIX_BYTES:
        long = ends - starts > n
        rows.append(row[long])
        found.append(mixed(hasher(part, starts[long], starts[long] + n) ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    return np.concatenate(rows), np.concatenate(found)


class Wanted:
    """Finds the numbers of features in a sorted list; a table of 2**16 places rules most others out."""

    def __init__(self, features: np.ndarray):
        self.features = features
        self.may = np.zeros(1 << 16, bool)
        self.may[(features & np.uint64(0xFFFF)).astype(np.int64)] = True

    def __call__(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `found` that hold one of the features, and its number."""
        at = np.flatnonzero(self.may[(found & np.uint64(0xFFFF)).astype(np.int64)])
        if not len(at):
            return at, at
        number = np.minimum(np.searchsorted(self.features, found[at]), len(self.features) - 1)
        same = self.features[number] == found[at]
        return at[same], number[same]


def features(column: pa.Array, wanted: Wanted | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, row, feature, times): how often each row has a feature, by row.

    With `wanted`, only those features, and by their numbers.
    """
    data, offsets = text_buffer(column)
    for a, b in slices(offsets):
        part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        bounds = cuts(part) if b - a == 1 and len(part) > SLICE_BYTES else [0, len(part)]
        rows, found, counts = [], [], []
        for x, y in zip(bounds, bounds[1:], strict=False):
            row, feature = found_in(part[x:y], own if len(bounds) == 2 else np.array([0, y - x]))
            if wanted is not None:
                at, feature = wanted(feature)
                row = row[at]
            row, feature, times = summed(row, feature, np.ones(len(row), np.int64))
            rows.append(row)
            found.append(feature)
            counts.append(times)
        yield a, b, *(summed(*(np.concatenate(x) for x in (rows, found, counts))) if len(rows) > 1 else (rows[0], found[0], counts[0]))


def summed(row: np.ndarray, feature: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of row and feature in order, and the sums of their times."""
    order = np.lexsort((feature, row))
    row, feature, times = row[order], feature[order], times[order]
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])))[: len(row)]
    return row[first], feature[first], np.add.reduceat(times, first) if len(first) else times


def fit_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, label, half, features, times) of the labelled rows to fit on; the sample has a fixed bound, so it may be broadcast.

    label is the grade if the labels have one, else 1 for toxic.
    """
    label = F.least(F.lit(GRADES - 1), F.col("grade").cast("int")) if "grade" in labels.columns else (F.col("toxic") > 0).cast("int")
    own = labels.select(F.col(id_col).cast("long").alias("id"), label.alias("label")).filter("id IS NOT NULL AND label IS NOT NULL")
    sample = own.groupBy("id").agg(F.greatest(F.lit(0), F.max("label")).alias("label")).orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS)
    half = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)).cast("int")
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    # an id may come a million times: one of its texts, the first by hash, stands for it
    chosen = found.groupBy("id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text")).select("id", "label", half.alias("half"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, row, found, times in features(batch.column(3)):
                ends = pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (found.view(np.int64), times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:3]), *lists], names=["id", "label", "half", "features", "times"])

    return chosen.mapInArrow(run, "id long, label int, half int, features array<long>, times array<int>")


def amount(times: np.ndarray) -> np.ndarray:
    return np.log2(1.0 + times)


def ordinal(rows: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds that maximise the likelihood of the grades of sparse rows, by Adam over all of them."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    x = np.concatenate([*values, np.zeros(0)])
    k = GRADES - 1
    above = (grades[:, None] >= np.arange(1, GRADES)[None, :]).astype(float)
    share = np.clip(above.mean(axis=0), 1e-4, 1 - 1e-4)
    start = np.maximum.accumulate(np.log((1 - share) / share))
    value = np.concatenate([np.zeros(size), [start[0]], np.log(np.maximum(np.diff(start), 0.1))])
    m, v = np.zeros_like(value), np.zeros_like(value)
    for step in range(1, STEPS + 1):
        w, gaps = value[:size], np.exp(value[size + 1 :])
        theta = value[size] + np.concatenate([[0], np.cumsum(gaps)])
        score = np.bincount(at, w[col] * x, minlength=len(rows))
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - theta[None, :], -40, 40)))
        padded = np.concatenate([np.ones((len(rows), 1)), p, np.zeros((len(rows), 1))], axis=1)
        i = np.arange(len(rows))
        mass = np.maximum(padded[i, grades] - padded[i, grades + 1], 1e-12)
        slope = np.concatenate([np.zeros((len(rows), 1)), p * (1 - p), np.zeros((len(rows), 1))], axis=1)
        by_theta = np.zeros((len(rows), k + 2))
        by_theta[i, grades] += slope[i, grades] / mass  # -d log(mass) / d theta: p falls as theta rises
        by_theta[i, grades + 1] -= slope[i, grades + 1] / mass
        t = by_theta[:, 1:-1] / len(rows)
        by_score = -t.sum(axis=1)
        grad = np.concatenate([np.bincount(col, by_score[at] * x, minlength=size) + RIDGE * w, [t.sum()], [t[:, j:].sum() * gaps[j - 1] for j in range(1, k)]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        value = value - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return value[:size], value[size] + np.concatenate([[0], np.cumsum(np.exp(value[size + 1 :]))])


def graded(toxic: np.ndarray, dose: np.ndarray) -> np.ndarray:
    """0 for rows that aren't toxic, 2 for toxic ones with a larger dose than the median toxic row, 1 for the others."""
    return np.where(toxic, 1 + (dose > np.median(dose[toxic])), 0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """A model from docs and labels (id_col, and grade or toxic).

    Labels without an id, a label or a document don't count; of repeated labels of an id the highest counts, and of repeated
    documents of an id one, so there are no more rows than FIT_ROWS. Without a toxic row, or without any other, nothing is toxic.
    """
    short_batches(docs.sparkSession)
    seen = staged(fit_rows(docs, labels, id_col, text_col), "labelled")
    toxic = (F.col("label") > 0).cast("int")
    n, positive = (x or 0 for x in seen.agg(F.count(F.lit(1)), F.sum(toxic)).first())
    if not positive or positive == n:
        return OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.array([40.0] * (GRADES - 1)))
    each = seen.select(toxic.alias("toxic"), "half", F.explode("features").alias("feature"))
    halves = [F.sum(F.when(F.col("half") == h, x)).alias(f"{c}{h}") for h in (0, 1) for c, x in (("k", F.lit(1)), ("t", F.col("toxic")))]
    per = staged(each.groupBy("feature").agg(F.count(F.lit(1)).alias("k"), F.sum("toxic").alias("t"), *halves).filter(F.col("k") >= LEAST_ROWS), "features")
    base, share, looked = positive / n, F.col("t") / F.col("k"), per.count()
    entropy = lambda p, q: F.when(p > 0, p * F.ln(p / q)).otherwise(0.0)
    nats = F.col("k") * (entropy(share, F.lit(base)) + entropy(1 - share, F.lit(1 - base)))  # bounds the binomial tail on either side
    odds = (F.col("t") + 0.5) / (F.col("k") - F.col("t") + 0.5) * ((n - positive) / positive)
    told = ((odds >= ODDS_FOR) | (odds <= 1 / ODDS_AGAINST)) & (F.col("k") < n) & (nats >= math.log(max(looked, 1) / CHANCE))
    comes = [F.coalesce(F.col(f"t{h}") > 0.5 * F.col(f"k{h}"), F.lit(False)) & (F.col(f"k{h}") >= LEAST_ROWS) for h in (0, 1)]
    listed = per.select("feature", told.alias("told"), *[x.alias(f"comes{h}") for h, x in enumerate(comes)]).filter("told OR comes0 OR comes1").collect()  # no more than the features of FIT_ROWS rows
    chosen, *by_half = (np.sort(np.array([r["feature"] for r in listed if r[name]], np.int64).view(np.uint64)) for name in ("told", "comes0", "comes1"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, others = Wanted(chosen), [Wanted(x) for x in by_half]
        for batch in batches:
            rows, times, dose = [], [], []
            for half, x, n in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                own, k = x.values.to_numpy(zero_copy_only=False).view(np.uint64), n.values.to_numpy(zero_copy_only=False)
                at, number = wanted(own)
                rows.append(number.tolist())
                times.append(k[at].tolist())
                dose.append(float(len(others[1 - half](own)[0])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dose), pa.array(rows, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))], names=["id", "label", "dose", "held", "times"])

    held = sorted(tuple(r) for r in seen.mapInArrow(run, "id long, label int, dose double, held array<int>, times array<int>").collect())  # FIT_ROWS rows
    rows, values = [np.array(r[3], np.int64) for r in held], [amount(np.array(r[4], float)) for r in held]
    label, dose = np.array([r[1] for r in held]), np.array([r[2] for r in held])
    grades = label if "grade" in labels.columns else graded(label > 0, dose)
    weights, thresholds = ordinal(rows, values, grades, len(chosen))
    model = OrdinalModel(chosen, weights, thresholds)
    model.toxic_from = best_cut(model.at_least(np.array([weights[r] @ v for r, v in zip(rows, values, strict=True)]))[:, 0], grades > 0, float(model.at_least(np.zeros(1))[0, 0]))
    return model


def best_cut(p: np.ndarray, toxic: np.ndarray, least: float = 0.0) -> float:
    """The cut over `least`, midway in log odds between two values of p, with the best F0.5 on the rows of the fit; of equal ones the highest.

    With the chance of a text without any feature as `least`, no text is toxic for what it doesn't hold.
    """
    odds = np.unique(np.round(np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6))), 4))
    cuts = np.append(1 / (1 + np.exp(-(odds[1:] + odds[:-1]) / 2)), 0.5)
    cuts = np.append(cuts[cuts > least], max(0.5, least + 1e-6))
    said = np.array([1.25 * (toxic & (p >= c)).sum() / ((p >= c).sum() + 0.25 * toxic.sum()) for c in cuts])  # a clean text lost is worse than a toxic one kept
    return float(cuts[said >= said.max() - 1e-12].max())


def scores(model: OrdinalModel, column: pa.Array) -> np.ndarray:
    """w . x of each row."""
    out, wanted = [], Wanted(model.features)
    for a, b, row, number, times in features(column, wanted):
        out.append(np.bincount(row, model.weights[number.astype(np.int64)] * amount(times), minlength=b - a))
    return np.concatenate([*out, np.zeros(0)])


def severity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, severity, p_toxic, grade, toxic) for each document: expected severity is the sum of P(grade >= k).

    A null, empty or blank text holds no feature and gets the model's base rate, which is not toxic; long texts are read
    whole; equal texts get equal grades; an empty table gives no rows. Other columns are not read.
    """
    short_batches(docs.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("severity", pa.float64()), ("p_toxic", pa.float64()), ("grade", pa.int32()), ("toxic", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.at_least(scores(model, batch.column(1)))
            first = np.round(p[:, 0], 6)
            yield as_batches({"id": batch.column(0), "severity": np.round(p.sum(axis=1), 6), "p_toxic": first, "grade": (p >= 0.5).sum(axis=1), "toxic": first >= model.toxic_from}, schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, severity double, p_toxic double, grade int, toxic boolean").withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the model doesn't find toxic.

    Null, empty and blank texts stay, repeated rows stay or go together, nulls in other columns make no difference, and an
    empty table stays empty.
    """
    short_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.at_least(scores(model, batch.column(at)))[:, 0]
            yield batch.filter(pa.array(np.round(p, 6) < model.toxic_from))

    return docs.mapInArrow(run, docs.schema)
