from __future__ import annotations

import random
import string
from collections import Counter

import pyarrow as pa
import pytest
import zstandard

from quireflow.llm import quality
from quireflow.llm.queries import QUERIES

from .conftest import by_id


def brute(text: str | None) -> dict:
    text = text or ""
    words = text.encode().split()
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return {"n_words": len(words), "word_chars": sum(len(w.decode()) for w in words), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"), "n_dup_lines": dup, "n_repeat_words": len(covered)}


def test_base_against_brute_force(spark, edge, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for df in (docs, edge):
        texts = {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
        found = by_id(quality.judged(df))
        assert set(found) == set(texts)
        for i, r in found.items():
            want = brute(texts[i])
            assert {k: r[k] for k in want} == want
            assert r["base_failed"] == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
            raw = (texts[i] or "").encode()
            if raw:
                assert abs(r["whole_ratio"] - len(zstandard.ZstdCompressor(level=3).compress(raw)) / len(raw)) < 1e-12
            assert r["kept"] == (not r["base_failed"] and not r["band_failed"])
    assert quality.judged(nothing).collect() == []


@pytest.fixture(scope="module")
def prose() -> bytes:
    """Clean texts of one language, one after another."""
    import duckdb

    rows = duckdb.execute("SELECT DISTINCT text FROM '/root/testdata/sf0.1/documents.parquet' JOIN '/root/testdata/sf0.1/labels.parquet' USING (doc_id) WHERE quality = 1 AND lang = 'en' AND length(text) BETWEEN 400 AND 5000 ORDER BY 1").fetchall()
    return "\n".join(r[0] for r in rows).encode()


def planted(kind: str, size: int, seed: int) -> str:
    """A text of about so many bytes that no base rule takes: words of a small template with a number, or random signs."""
    rng = random.Random(seed)
    if kind == "repetitive":
        words = [f"alpha beta {k}" for k in rng.sample(range(10 * size), size // 12 + 1)] if size > 900 else [f"aa bb {k}" for k in rng.sample(range(900), size // 7)]
    else:
        words = ["".join(rng.choices(string.ascii_letters + string.digits + "+/", k=rng.randint(2, 5))) for _ in range(size // 4 + 1)]
    text = " ".join(words)[:size]
    found = brute(text)
    assert found["n_words"] >= 50 and 100 * found["n_repeat_words"] <= 50 * found["n_words"]
    return text


@pytest.mark.parametrize("size", [300, 700, 1500, 3000, 6000, 12_000, 30_000, 100_000, 1_500_000])
def test_each_length_has_texts_that_only_the_bands_reject(size, prose):
    compress = zstandard.ZstdCompressor(level=3).compress
    for k in range(5):
        assert quality.compression(planted("repetitive", size, k).encode(), compress)[-1]
        assert quality.compression(planted("incompressible", size, k).encode(), compress)[-1]
        assert not quality.compression(prose[k * 1000 : k * 1000 + size], compress)[-1]


def test_chunks_decide_where_the_whole_passes():
    compress = zstandard.ZstdCompressor(level=3).compress
    text = (planted("repetitive", 3000, 1) + " " + planted("incompressible", 5200, 2)).encode()
    ratio, chunks, low, high, failed = quality.compression(text, compress, whole=((1, 0.0, 2.0),))
    assert failed and chunks == 8 and low >= 2 and high >= 4
    assert quality.compression(b"", compress) == (0.0, 0, 0, 0, False)
    assert quality.compression(b"x" * 1500, compress)[1:4] == (1, 1, 0)
    for bands in (quality.WHOLE_BANDS, quality.CHUNK_BANDS):
        assert [tuple(float(x) for x in quality.band(n, bands)) for n in (1, 1 << 40)] == [bands[0][1:], bands[-1][1:]]
        assert all(quality.band(n, bands)[0] == low for n, low, _ in bands)


def test_long_texts_are_cut_inside(monkeypatch):
    text = "a line of words and words\n" * 70_000 + "é" * 50_000 + "\n  \n one line\n one line " + "x y " * 50_000
    own = quality.Measure()
    (_, _, found), = own(pa.array([text]))
    want = brute(text)
    assert {k: list(found[k]) for k in want} == {k: [v] for k, v in want.items()}


def test_labelled_bad_documents_that_only_the_bands_take(spark):
    found = QUERIES["op3_quality_rules"](spark, "/root/testdata/sf0.1")
    bad = found.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("quality = 0 AND NOT base_failed")
    n, taken, by_chunks = bad.selectExpr("count(*)", "count_if(NOT kept)", "count_if(low_chunks + high_chunks > 0.25 * n_chunks)").first()
    assert taken >= 0.5 * n and by_chunks >= 0.4 * n


def test_labelled_clean_documents_stay(spark):
    found = QUERIES["op3_quality_rules"](spark, "/root/testdata/sf0.1")
    clean = found.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("quality = 1 AND NOT base_failed")
    assert clean.filter("NOT kept").count() == 0 < clean.count()


def test_passing_keeps_columns(spark, edge):
    assert quality.passing(edge).columns == edge.columns
    assert quality.passing(edge).count() == quality.judged(edge).filter("kept").count()
