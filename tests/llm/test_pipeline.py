from __future__ import annotations

import corpus_pipeline
import zstandard

from quireflow.llm import packing, quality, toxicity
from quireflow.llm.queries import tokenizer_path

from .test_minhash import brute as components_of
from .test_packing import check
from .test_quality import brute as counted
from .test_secrets import scan

FOLDER = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    toxic = {r["doc_id"] for r in toxicity.severity(docs, model).filter("toxic").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] not in toxic}
    compress = zstandard.ZstdCompressor(level=quality.LEVEL).compress
    for i in list(texts):
        c = counted(texts[i])
        if c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"] or quality.compression(texts[i].encode(), compress)[-1]:
            del texts[i]
    texts = {i: texts[i] for i, (_, home) in components_of(texts, 5, 80).items() if home == i}
    for i, spans in zip(texts, scan(list(texts.values())), strict=True):
        done, out = 0, []
        for _, a, b in spans:
            if a >= done:
                out += [texts[i][done:a], "[SECRET]"]
            done = max(done, b)
        texts[i] = "".join(out) + texts[i][done:]
    found = corpus_pipeline.run(spark, FOLDER).collect()
    bins = check(found, texts, 2048, packing.Encoder(tokenizer_path("word_bpe_49k.json")).tokenizer)
    assert len(bins) <= -(-sum(r["length"] for r in found) // 2048) + 1


def test_stages_keep_the_columns_and_take_edges(spark, edge):
    base = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = edge.selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "lang AS source", "CAST(length(text) AS long) AS n_chars")
    docs = base.unionByName(odd).unionByName(base.limit(3).selectExpr("doc_id + 200000 AS doc_id", "text", "lang", "source", "n_chars"))
    for name, stage in corpus_pipeline.STAGES:
        fresh = stage(spark, docs, FOLDER)
        rows = fresh.collect()
        assert rows, name
        if name != "packing":
            assert fresh.dtypes == docs.dtypes
            docs = spark.createDataFrame(rows, docs.schema)
    none = base.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, FOLDER).collect() == [], name


def test_near_duplicates_keep_null_ids_and_one_of_repeated_rows(spark):
    one, two, three, four = (" ".join(f"{w}{k}" for k in range(60)) for w in "abcd")
    rows = [(None, one), (None, two), (7, three), (7, three), (9, four), (3, four), (None, four), (None, three)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = corpus_pipeline.without_near_duplicates(spark, docs, FOLDER).collect()
    assert sorted((r["text"], r["doc_id"] or 0) for r in found) == [(one, 0), (two, 0), (three, 7), (four, 3)]
