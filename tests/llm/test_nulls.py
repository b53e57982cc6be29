"""Rows without an id, and columns whose names operators use inside, in every operator on texts."""

from __future__ import annotations

import pytest

from quireflow.llm import lm_scoring, media, minhash, packing, quality, secrets, sp_fst, toxicity
from quireflow.llm.queries import tokenizer_path

OPERATORS = {
    "minhash": lambda df: minhash.near_duplicates(df),
    "secrets": lambda df: secrets.secret_spans(df),
    "quality": lambda df: quality.judged(df),
    "toxicity": lambda df: toxicity.severity(df, toxicity.fit(df, df.selectExpr("doc_id", "1 AS toxic"))),
    "lm": lambda df: lm_scoring.scored(df),
    "media": lambda df: media.as_media(df),
    "pieces": lambda df: sp_fst.encode(df, tokenizer_path("piece_bpe_32k.model")),
    "trip": lambda df: sp_fst.round_trip(df, tokenizer_path("piece_bpe_32k.model")),
    "packing": lambda df: packing.pack(df, tokenizer_path("word_bpe_49k.json")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_without_an_id(spark, name):
    rows = [(None, "same text here", 1, "a"), (None, "same text here", 2, "b"), (None, None, 3, None), (5, "same text here", None, "c"), (None, "another one", 4, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int, rank string").withColumnsRenamed({"rank": "part"})
    found = OPERATORS[name](df).collect()
    assert sorted((r["doc_id"] is None) for r in found) == [False, True, True, True, True]
    if name == "minhash":
        kept = {r["doc_id"]: r["kept"] for r in found if r["kept"]}
        assert kept == {5: True} and sum(r["component_id"] == 5 for r in found) == 3
