from __future__ import annotations

import math
import re
import string
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quireflow.llm import common, lm_scoring

from .conftest import by_id, twins


def brute(texts: dict) -> tuple[dict, int]:
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in texts.items()}
    out_of = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(w for i, t in tokens.items() if not out_of[i] for w in t)
    total, distinct = sum(counts.values()), len(counts)
    return {i: (out_of[i], len(t), sum(counts[w] > 0 for w in t), sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in t)) for i, t in tokens.items()}, total


def test_against_brute_force_and_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(5)
    want, total = brute({r["doc_id"]: r["text"] for r in docs.collect()})
    found = by_id(lm_scoring.scored(docs))
    for i, r in found.items():
        assert (r["held_out"], r["n_tokens"], r["n_known"]) == want[i][:3] and r["train_tokens"] == total
        assert abs(r["base_score"] - want[i][3]) < 1e-8 * abs(want[i][3])
    held = [r for r in found.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_edges(spark, edge, nothing, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SLICE_TEXT", 1000)
    want, total = brute({r["doc_id"]: r["text"] for r in edge.collect()})
    found = by_id(lm_scoring.scored(edge))
    assert set(found) == set(want)
    for i, r in found.items():
        assert (r["held_out"], r["n_tokens"], r["n_known"]) == want[i][:3] and math.isfinite(r["score"])
        assert abs(r["base_score"] - want[i][3]) < 1e-6 * abs(want[i][3])
    assert found[0]["score"] == found[1]["score"] == found[2]["score"] and found[0]["n_tokens"] == 1
    assert lm_scoring.scored(nothing).collect() == []
    alone = lm_scoring.scored(spark.createDataFrame([(9, "only")], "doc_id long, text string")).first()  # may be held out: nothing learnt
    assert math.isfinite(alone["score"]) and math.isfinite(alone["base_score"])


def test_score_against_brute_force(spark):
    """Each token's probability term by term: scores of all classes, their sum, and the counts within the class."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).union(spark.createDataFrame([(10_001, " ".join(twins(1024))), (10_002, None)], "doc_id long, text string"))
    rows = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    counted, texts, model = lm_scoring.fitted(docs)
    found = by_id(lm_scoring.scored_by(texts, model).withColumnRenamed("id", "doc_id"))
    tokens = {i: [w.translate(bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())) for w in re.split(rb"[\x20\x09-\x0d]+", t) if w] for i, t in rows.items()}
    counts = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    hasher = common.WordHasher(word_hasher_seed())

    def hashed(word):
        data = np.frombuffer(word, np.uint8)
        return hasher(data, np.array([0]), np.array([len(data)]))[0], lm_scoring.endings(data, np.array([0]), np.array([len(data)]))[0]

    words = {w: hashed(w) for t in tokens.values() for w in t}
    assert len({h for h, _ in words.values()}) == len(words)
    most = counted.filter("c > 0").orderBy(F.col("c").desc(), "word").limit(lm_scoring.TOP).collect()
    own = {int(np.int64(r["word"]).view(np.uint64)): k for k, r in enumerate(most, 1)}
    kind = {w: own.get(int(h), int(k)) for w, (h, k) in words.items()}
    assert set(own) <= {int(h) for h, _ in words.values()} and min(counts[w] for w in words if int(words[w][0]) in own) >= max((counts[w] for w in words if int(words[w][0]) not in own), default=0)
    members = {}
    for w, k in kind.items():
        if counts[w]:
            members.setdefault(k, []).append(counts[w])
    w, opened = model.weights, np.flatnonzero(model.open)
    for i, row in list(found.items())[:12] + [(k, found[k]) for k in (10_001, 10_002)]:
        total, h, g = 0.0, 0, 0
        for word in [*tokens[i], None]:
            k = 0 if word is None else kind[word]
            u = w.c[0].astype(float) * w.r[h] + w.c[1].astype(float) * w.r[g]
            s = w.q[opened].astype(float) @ u + w.b[opened]
            total += (s[np.searchsorted(opened, k)] - np.log(np.exp(s).sum())) / np.log(10)
            if k > lm_scoring.TOP:
                total += math.log10((counts[word] + 1) / (sum(members.get(k, [])) + len(members.get(k, [])) + 1))
            h, g = k, h
        assert abs(row["score"] - total) < 1e-4 * abs(total)


def word_hasher_seed():
    return int(common.word_hasher().seed)


def test_model_is_normalised_and_learns_order():
    size, rng = 6, np.random.default_rng(3)
    truth = rng.dirichlet(np.full(size, 0.3), (size, size))
    tokens = [0]
    a, b = 0, 1
    for _ in range(60_000):
        c = rng.choice(size, p=0.5 * truth[0, b] + 0.5 * truth[1, b])
        tokens.append(c)
        a, b = b, c
    tokens = np.array(tokens)
    share = np.bincount(tokens, minlength=size) / len(tokens)
    w = lm_scoring.Weights.first(share)
    for _ in range(20):
        lm_scoring.train_nce(w, share, tokens, np.array([0]), np.ones(len(tokens), bool), rng)
    model = lm_scoring.Model(w, np.ones(size, bool), 0, 0, np.zeros(size), np.zeros(size))
    table = lm_scoring.Tables(model)
    every = np.arange(size)
    p = 10 ** np.array([[table.log10(every, np.full(size, h), np.full(size, g)) for g in range(size)] for h in range(size)])
    assert np.allclose(p.sum(axis=2), 1, atol=1e-5)
    before, earlier = lm_scoring.tokens_before(tokens, np.array([0]))
    cross = -np.log(p[before, earlier, tokens]).mean()
    pairs = np.zeros((size, size))
    np.add.at(pairs, (before, tokens), 1)
    pairs /= pairs.sum(axis=1, keepdims=True)
    assert cross < -np.log(share[tokens]).mean() - 0.1 and cross < -np.log(pairs[before, tokens]).mean() + 0.05


def test_copies_are_averaged_in_a_tree(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(7)
    monkeypatch.setattr(lm_scoring, "FAN", 2)
    monkeypatch.setattr(lm_scoring, "SLICE_TEXT", 20_000)
    found = by_id(lm_scoring.scored(docs))
    held = [r for r in found.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_words_of_the_rest_have_vectors_of_their_own(spark):
    rng = np.random.default_rng(5)
    usual = [f"c{k}" for k in range(lm_scoring.CLASSES)]
    rows = [" ".join([*(w for _ in range(5) for w in usual), *(x for k in rng.integers(0, 20, 40) for x in (f"a{k}", f"b{k}"))]) for _ in range(60)]
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 7 == 2]
    right = [f"a{k} b{k}" for k in range(20)]
    wrong = [f"a{k} b{(k + 1) % 20}" for k in range(20)]
    docs = spark.createDataFrame([*zip(ids, rows, strict=False), *zip(held, right + wrong, strict=False)], "doc_id long, text string")
    found = by_id(lm_scoring.scored(docs))
    score = [found[i]["score"] for i in held[:40]]
    assert sum(score[:20]) > sum(score[20:]) + 10
    assert sum(x > y for x, y in zip(score[:20], score[20:], strict=True)) >= 18


def test_the_number_of_tasks_changes_little(spark):
    """The same corpus in 1 and in 50 tasks: held-out scores differ by less than a hundredth, texts by less than a tenth."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one, many = (by_id(lm_scoring.scored(docs.repartition(n))) for n in (1, 50))
    held = [i for i, r in one.items() if r["held_out"]]
    totals = [sum(found[i]["score"] for i in held) for found in (one, many)]
    print("held-out scores in 1 and 50 tasks:", totals)
    assert abs(totals[0] - totals[1]) < 0.01 * abs(totals[0])
    assert all(abs(one[i]["score"] - many[i]["score"]) < 0.1 * abs(one[i]["score"]) for i in held)
