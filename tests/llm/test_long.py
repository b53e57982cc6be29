"""Very long texts: every kernel cuts them inside, so what it needs beside the text grows with its words, not by tens of times."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quireflow.llm import common, html_text, lm_scoring, media, minhash, packing, quality, secrets, sp_fst, toxicity
from quireflow.llm.queries import tokenizer_path

SIZE = 12_000_000
WORDS = [f"{a}{b}{c}" for a in ("th", "an", "wor", "den", "é", "ka") for b in ("in", "er", "ation", "o") for c in ("", "s", "ing.", "\n")]


@pytest.fixture(scope="module")
def column() -> pa.Array:
    rng = np.random.default_rng(1)
    text = " ".join(np.array(WORDS)[rng.integers(0, len(WORDS), SIZE // 7)].tolist())
    return pa.array([text], pa.string())


def drained(kernel) -> int:
    """The most bytes that Python and numpy hold at once while a kernel runs."""
    tracemalloc.start()
    for _ in kernel:
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


def near_duplicates(column):
    for _, _, sets in common.shingle_sets(column, 5):
        minhash.signature(sets[0])
        yield


def scored(column):
    for a, b, size, hashes, kinds in lm_scoring.words_of(*common.text_buffer(column)):
        yield np.unique(hashes, return_index=True, return_inverse=True)


def toxic(column):
    model = toxicity.OrdinalModel(np.sort(common.mixed(np.arange(100, dtype=np.uint64))), np.ones(100), np.array([1.0, 2.0]))
    yield toxicity.scores(model, column)


def pictures(column):
    raw = column[0].as_py().encode()
    image = media.to_image(raw)
    payload, n = media.from_image(image)
    assert n == len(raw) and payload[:n] == raw
    yield media.feature(payload)


def page(column):
    yield html_text.main_text("<article><p>" + column[0].as_py().replace("\n", "</p><p>") + "</article>", html_text.train())


def decoded(column):
    own = sp_fst.PieceEncoder(tokenizer_path("piece_bpe_32k.model"))
    for _, _, ids, offsets in own(column):
        (text,) = own.texts(ids, offsets)
        assert text[1:] == column[0].as_py().encode()
        yield


KERNELS = {
    "op1": (near_duplicates, 16),
    "op2": (secrets.scanned, 8),
    "op3": (lambda column: quality.Measure()(column), 16),
    "op4": (toxic, 8),
    "op5": (page, 24),
    "op6": (scored, 16),
    "op8": (pictures, 8),
    "op9": (decoded, 20),
    "op10": (lambda column: packing.Encoder(tokenizer_path("word_bpe_49k.json"))(column), 10),
}


@pytest.mark.parametrize("name", list(KERNELS))
def test_memory_for_a_long_text(column, name):
    kernel, times = KERNELS[name]
    size = column.nbytes
    small = drained(kernel(pa.array([column[0].as_py()[:1000]])))  # tables and vocabularies that any text needs
    assert (drained(kernel(column)) - small) / size < times
