from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quireflow.llm import common, sp_fst
from quireflow.llm.queries import tokenizer_path

from .conftest import by_id, twins

PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def own():
    return sp_fst.PieceEncoder(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids_of(own, texts):
    out = []
    for a, b, ids, offsets in own(pa.array(texts, pa.string())):
        out += [ids[offsets[k] : offsets[k + 1]].tolist() for k in range(b - a)]
    return out


parts = st.sampled_from(["a", "the", "é", "ß", "in", "tion", " ", " ", "  ", " " * 5, "1", "\n", "\t", "▁", "中", "😀", "-", "<s>", "<0x0A>", "\x85", ".", " ", "thonere", "xxxxxxx", " " * 40, "ing", "Sch"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(parts, max_size=16).map("".join), min_size=1, max_size=4))
def test_ids_and_text_are_the_librarys(own, library, texts):
    found = ids_of(own, texts)
    assert found == library.encode(texts)
    assert [own.machine.decode(x) for x in found] == library.decode(found)
    assert [own.machine.encode(t) for t in texts] == found  # without units and cache


def test_it_is_the_minimum_that_decides(own, library, monkeypatch):
    """With the last arc instead of the lightest, the same machines give other ids: byte fallback is open at every symbol."""
    machine = sp_fst.Transducer(open(PATH, "rb").read())
    text = "the nation thinks, and so on"
    assert machine.encode(text) == library.encode(text)
    monkeypatch.setattr(sp_fst, "heappop", list.pop)
    other = machine.encode(text)
    assert other != library.encode(text) and machine.decode(other).replace("▁", " ").strip() == text


def test_least_weight_of_all_paths_of_the_composition(own):
    """A search through all paths of N, L and G finds none that weighs less."""
    machine = own.machine
    for text in ("then", " a in", "ß中x", "1 is"):
        symbols = machine.normaliser.compose(text, True)
        far = machine.span * (len(symbols) + 1)

        def paths(place, last, symbols=symbols, far=far):
            if place == len(symbols):
                yield 0.0, []
                return
            arcs = [(machine.weight[i], [i], len(t), i) for t in {symbols[place:k] for k in range(place + 1, len(symbols) + 1)} if t in machine.score for i in [machine.text.index(t)] if machine.follows(last, i)]
            arcs.append((far, machine.fallback(symbols[place])[::-1], 1, -2))
            for w, ids, n, now in arcs:
                for rest, more in paths(place + n, now):
                    yield w + rest, ids + more

        assert min(paths(0, -1))[1] == machine.shortest_path(symbols)[1] == machine.encode(text)


@pytest.mark.parametrize(("dummy", "squeeze"), [(True, True), (True, False), (False, True), (False, False)])
def test_normaliser(dummy, squeeze):
    import re

    for text in ("", " ", "a", "  a  b ", "a b", "▁ a", "a\n b", "   "):
        want = re.sub(" +", " ", text).strip(" ") if squeeze else text
        want = ("▁" if dummy and want else "") + want.replace(" ", "▁")
        assert sp_fst.Normaliser(dummy, squeeze).compose(text, True) == want


@pytest.mark.parametrize("size", [256, 1024, 4096])
def test_words_that_polynomial_hashes_confuse(own, library, size):
    texts = [" ".join(twins(size)), *twins(size)]
    assert ids_of(own, texts) == library.encode(texts)


def test_long_texts_are_cut_inside_and_the_cache_starts_anew(own, library, monkeypatch):
    monkeypatch.setattr(sp_fst, "SLICE_BYTES", 100)
    monkeypatch.setattr(sp_fst, "cuts", lambda part, safe: common.cuts(part, safe, most=100))
    monkeypatch.setattr(sp_fst, "KNOWN_PAIRS", 50)
    texts = ["don't stop  now, 中文 ▁ the nation\n" * 40, "x" * 3000, "short", " " * 500 + "end", "中文字" * 300]
    assert [ids_of(own, [t])[0] for t in texts] == library.encode(texts)


def test_documents(spark, library, edge, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for df in (docs, edge.filter("doc_id NOT IN (7, 8)")):
        texts = {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}
        ids = {i: r["ids"] for i, r in by_id(sp_fst.encode(df, PATH)).items()}
        assert ids == {i: library.encode(t) for i, t in texts.items()}
        for i, r in by_id(sp_fst.round_trip(df, PATH)).items():
            assert r["exact"] and r["n_ids"] == len(ids[i]) and r["ids_crc32"] == zlib.crc32(np.array(ids[i], "<u4").tobytes())
        assert {i: r["text"] for i, r in by_id(sp_fst.decode(sp_fst.encode(df, PATH), PATH)).items()} == texts
    assert by_id(sp_fst.round_trip(edge, PATH))[7]["exact"]
    assert sp_fst.encode(nothing, PATH).collect() == []


def message(number: int, kind: int, value) -> bytes:
    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    body = varint(value) if kind == 0 else struct.pack("<f", value) if kind == 5 else varint(len(value)) + value
    return varint(number << 3 | kind) + body


def unigram_model(pieces: list[tuple[str, float]]) -> bytes:
    one = lambda t, s, k: message(1, 2, message(1, 2, t.encode()) + message(2, 5, s) + message(3, 0, k))
    head = one("<unk>", 0.0, 2) + one("<s>", 0.0, 3) + one("</s>", 0.0, 3)
    return head + b"".join(one(t, s, 1) for t, s in pieces) + message(2, 2, message(3, 0, 1)) + message(3, 2, message(1, 2, b"identity") + message(3, 0, 1) + message(4, 0, 0))


def test_unigram_models_take_the_path_of_least_weight():
    import itertools
    import random

    rng = random.Random(4)
    texts = {"".join(rng.choices("ab▁", k=rng.randint(1, 4))) for _ in range(25)} | {"a", "b", "▁"}
    weights = {t: round(-rng.uniform(1, 9), 3) for t in sorted(texts)}
    machine = sp_fst.Transducer(unigram_model(list(weights.items())))
    for n in range(1, 8):
        for text in {"".join(rng.choices("ab ", k=n)) for _ in range(12)}:
            norm = machine.normaliser.compose(text, True)
            best = max(sum(weights[norm[a:b]] for a, b in itertools.pairwise([0, *cuts, len(norm)])) for k in range(len(norm)) for cuts in itertools.combinations(range(1, len(norm)), k) if all(norm[a:b] in weights for a, b in itertools.pairwise([0, *cuts, len(norm)])))
            cost, ids = machine.path(norm)
            assert "".join(machine.text[i] for i in ids) == norm and abs(cost + best) < 1e-4
            assert machine.decode(machine.encode(text)) == text


def test_models_that_are_not_supported():
    with pytest.raises(ValueError, match="character map"):
        sp_fst.Transducer(message(3, 2, message(2, 2, b"map")))
