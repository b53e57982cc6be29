from __future__ import annotations

import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest

from quireflow.llm import sale_state as S
from quireflow.llm import sales as M

START, HOUR = datetime(2024, 1, 1), timedelta(hours=1)
SALES = "sale_id long, client_id long, sold_at timestamp_ntz, arrived_at timestamp_ntz, valid_at string"
CHANGES = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, balance double"


def low(x):
    return (x is not None, x if x is not None else 0)


def brute(sales: list, changes: list, batches: int, days: int) -> list:
    """The contract, one batch and one row after the other."""
    number = lambda d: max(0, min(batches - 1, d * batches // days))
    own = defaultdict(list)
    for r in sales:
        own[number((r[3] - START).days) if r[3] else batches - 1].append(r)
    new = defaultdict(list)
    for r in {r for r in changes if r[4] is not None}:
        shift = zlib.crc32(str(r[0]).encode()) % 4 if r[0] is not None else 0
        new[number((r[4] - START).days + shift)].append(r)
    versions, waiting, out = defaultdict(list), [], []
    order = lambda r: (r[4], low(r[2]), low(r[0]))

    def emit(rows, b):
        for r in rows:
            held = versions[r[1]] if r[1] is not None else []
            fit = [v for v in held if r[2] is not None and v[4] <= r[2]]
            v = max(fit, key=order) if fit else None
            out.append(("sale", r[0], b, len(held), v and v[0], None if v is None or v[5] is None else int(np.floor(100 * v[5] + 0.5)), v and v[3]))

    for b in range(batches):
        most = [max((r[k] for c in range(b) for r in rows[c] if r[k] is not None), default=None) for rows, k in ((own, 2), (new, 4))]
        ws, wc = (x and x - 12 * HOUR for x in most)
        h = min(ws, wc) if ws and wc else None
        for r in new[b]:
            if wc and r[4] < wc:
                out.append(("late", r[0], b, None, None, None, None))
            elif r[1] is not None:
                versions[r[1]].append(r)
        rows = waiting + own[b]
        ready = [r for r in rows if r[2] is None or (h and r[2] < h)]
        waiting = [r for r in rows if not (r[2] is None or (h and r[2] < h))]
        emit(ready, b)
        for held in versions.values():
            passed = sorted((v for v in held if h and v[4] <= h), key=order)
            for v in passed[:-1]:
                held.remove(v)
    emit(waiting, batches)
    return sorted(out, key=str)


def tables(n: int, seed: int) -> tuple[list, list]:
    """A shop of 12 days: a hot client, nulls, ties, repeated and late rows, and a gap of days without any."""
    rng = random.Random(seed)
    client = lambda: rng.choice([7, 7, 7, 1, 2, 3, 4, None])
    time = lambda: START + HOUR * rng.choice([k for k in range(12 * 24) if not 96 <= k < 168])
    sales = []
    for k in range(n):
        at = time() if rng.random() > 0.05 else None
        sales.append((k, client(), at, None if rng.random() < 0.02 else (at or time()) + HOUR * rng.choice([0, 0, 1, 60]), "x"))
    sales += sales[:5] + [(None, 7, START, START, None)]
    changes = [(k, client(), rng.choice([0, 1, None]), rng.choice(["I", "U", "D", None]), time() if rng.random() > 0.03 else None, None if rng.random() < 0.1 else round(rng.uniform(-99, 99), 2)) for k in range(n)]
    changes += changes[:20] + [(None, 7, 1, "U", START, 1.0)]
    return sales, changes


@pytest.mark.parametrize("how", [{}, {"hot_rows": 40, "span_rows": 15, "slot_rows": 20}])
def test_against_brute_force(spark, how):
    sales, changes = tables(200, 5)
    found = M.enriched(spark.createDataFrame(sales, SALES), spark.createDataFrame(changes, CHANGES).repartition(3), batches=4, days=12, **how)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(sales, changes, 4, 12)
    assert spark.conf.get("spark.sql.streaming.minBatchesToRetain") == "100"  # the session's settings are as before


def test_empty_tables(spark):
    none, no_changes = spark.createDataFrame([], SALES), spark.createDataFrame([], CHANGES)
    assert M.enriched(none, no_changes, batches=1, days=12).collect() == []
    one = spark.createDataFrame([(1, 7, START, START, None)], SALES)
    assert [tuple(r) for r in M.enriched(one, no_changes, batches=1, days=12).collect()] == [("sale", 1, 1, 0, None, None, None)]


def test_segments():
    """A version that comes in splits the segment it falls into, and what H has passed goes with its segments."""
    versions = lambda at: {"client": np.zeros(len(at), np.int64), "at": np.array(at, np.int64), "seq": np.zeros(len(at), np.int64), "id": np.arange(len(at)), "cents": np.zeros(len(at), np.int64), "op": np.array(["U"] * len(at), object)}
    sales = {"client": np.zeros(4, np.int64), "known": np.array([True, True, True, False]), "at": np.array([1, 5, 9, 9]), "id": np.arange(4)}
    first = S.inserted(versions([]), versions([4]))
    assert S.owners(first, sales).tolist() == [-1, 0, 0, -1]
    split = S.inserted(first, versions([7]))
    assert S.owners(split, sales).tolist() == [-1, 0, 1, -1]
    assert S.held(split, sales).tolist() == [2, 2, 2, 0]
    assert S.pruned(split, 6)["at"].tolist() == [4, 7] and S.pruned(split, 7)["at"].tolist() == [7]
    assert S.pruned(split, S.NONE)["at"].tolist() == [4, 7]
    assert S._unpacked([S._packed(split, S.VERSIONS)] * 2, S.VERSIONS)["at"].tolist() == [4, 7, 4, 7]
