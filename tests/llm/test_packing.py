from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quireflow.llm import common, packing
from quireflow.llm.queries import tokenizer_path

from .conftest import twins

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def fresh():
    """The tokenizer as its file says, with nothing set."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(PATH)


def ids_of(encoder, texts):
    out = []
    for a, b, ids, offsets in encoder(pa.array(texts, pa.string())):
        out += [ids[offsets[k] : offsets[k + 1]].tolist() for k in range(b - a)]
    return out


parts = st.sampled_from(["a", "Bé", "ß", "×", "'", "s", "'ll", "I'M", "1", "²", "٣", "!?", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "  ", "\n", " ", "é", "中", "😀", "-", "_", "İ", "Σ", "\x85", "\x1c", "\x07", "word", "("])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(parts, max_size=14).map("".join), min_size=1, max_size=5))
def test_units_give_the_tokenizers_ids(encoder, fresh, texts):
    assert ids_of(encoder, texts) == [e.ids for e in fresh.encode_batch(texts, add_special_tokens=False)]


def test_strings_of_special_tokens_are_these_tokens(encoder, fresh):
    assert ids_of(encoder, ["<|endoftext|> hi", "a<|endoftext|>b", "<|endof", "text|>"]) == [[49407, 1883], *(fresh.encode(t, add_special_tokens=False).ids for t in ("a<|endoftext|>b", "<|endof", "text|>"))]


def test_cache_may_start_anew(encoder, fresh, monkeypatch):
    monkeypatch.setattr(encoder, "cached", 3)
    texts = ["one two three four", "five six one", None, ""]
    for _ in range(3):
        assert ids_of(encoder, texts) == [fresh.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("size", [256, 1024, 4096])
def test_words_that_polynomial_hashes_confuse(encoder, fresh, size):
    texts = [" ".join(twins(size)), *twins(size)]
    assert ids_of(encoder, texts) == [fresh.encode(t, add_special_tokens=False).ids for t in texts]


def test_equal_hashes_of_different_units_do_no_harm(encoder, fresh, monkeypatch):
    own = encoder.hashed
    monkeypatch.setattr(encoder, "hashed", lambda part, starts, ends: np.where(ends - starts > 8, np.uint64(7), own(part, starts, ends)))
    texts = ["one two six ten and thirteen of fourteen or fifteens", "ninety nine"]
    assert ids_of(encoder, texts) == [fresh.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_texts_are_cut_inside(encoder, fresh, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_BYTES", 100)
    monkeypatch.setattr(packing, "cuts", lambda part: common.cuts(part, most=100))
    texts = ["don't stop <|endoftext|> now, 中文 " * 40, "x" * 5000, "short", " " * 500 + "end"]
    assert [ids_of(encoder, [t])[0] for t in texts] == [fresh.encode(t, add_special_tokens=False).ids for t in texts]


def test_another_tokenizer_takes_the_whole_way():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    own, texts = packing.Encoder(path), ["One  two\n12 <|endoftext|> é", "", None, "x"]
    assert not own.by_unit and ids_of(own, texts) == [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=200))
def test_plan_uses_all_pieces_and_no_bin_overflows(lengths):
    counts = np.bincount(np.array(lengths, int), minlength=41)
    plan = packing.minimum_bin_slack(counts, 40)
    used = np.zeros(41, int)
    for bins, combination in plan:
        assert bins > 0 and sum(n * k for n, k in combination) <= 40
        for n, k in combination:
            used[n] += bins * k
    assert (used == counts).all()


def test_a_bin_takes_the_fullest_combination():
    counts = np.zeros(101, int)
    for n in (60, 33, 30, 25, 15, 10):  # beside 60 best fit decreasing would take 33, and leave 7
        counts[n] += 1
    assert packing.minimum_bin_slack(counts, 100)[0] == (1, [(60, 1), (30, 1), (10, 1)]) or sum(n * k for n, k in packing.minimum_bin_slack(counts, 100)[0][1]) == 100


def check(found, texts, capacity, tokenizer):
    by_doc: dict = {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for i, rows in by_doc.items():
        ids = np.array(tokenizer.encode(texts[i] or "", add_special_tokens=False).ids + [0], "<u4")
        want = [(k, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins: dict = {}
    for r in found:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for rows in bins.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def test_documents(spark, fresh):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(6)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = packing.pack(docs, PATH).collect()
    bins = check(found, texts, 2048, fresh)
    assert len(bins) <= -(-sum(r["length"] for r in found) // 2048) + 1


def test_edges_and_sequences(spark, edge, nothing, fresh):
    texts = {r["doc_id"]: r["text"] for r in edge.collect()}
    packed = packing.pack(edge, PATH, capacity=64, keep_ids=True)
    found = packed.collect()
    check(found, texts, 64, fresh)
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for r in found:
        assert whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]
    assert packing.pack(nothing, PATH).collect() == []
