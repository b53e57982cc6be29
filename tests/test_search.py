from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quireflow.operators import batch as B
from quireflow.operators import keywords as K
from quireflow.operators import retrieval as R
from quireflow.sources import markup
from quireflow.sources.web import TableSearch


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(4)
    usual, rare = [f"the{k}" for k in range(5)], [f"word{k}" for k in range(300)]
    rows = [(k, " ".join(rng.choices(usual, k=30) + rng.choices(rare, k=rng.randrange(1, 12)))) for k in range(400)] + [(900, None), (901, "...")]
    return K.KeywordIndex(spark, str(tmp_path_factory.mktemp("words") / "index")).build(spark.createDataFrame(rows, "doc_id long, text string"))


def test_what_is_skipped_changes_nothing(spark, index):
    rng = random.Random(9)
    asked = [(k, " ".join([*rng.choices([f"the{j}" for j in range(5)], k=4), *rng.choices([f"word{j}" for j in range(300)], k=3)])) for k in range(40)] + [(50, "the0 the1"), (51, "nothing known"), (52, None), (53, "word7")]
    questions = spark.createDataFrame(asked, "question long, text string")
    rows = lambda **how: sorted((r["question"], r["rank"], r["doc_id"], round(r["score"], 8)) for r in index.search_each(questions, 5, **how).collect())
    fast, whole = rows(), rows(skip=False)
    assert fast == whole and {q for q, *_ in fast} == {*range(40), 50, 53}
    assert index.stats()["documents"] == 402 and index.terms().filter("term = 'the0'").first()["df"] > 300


def test_whole_words(spark):
    pages = spark.createDataFrame([(1, "a", "http://a", "the season of rain"), (2, "b", "http://b", "The SEA, and sea again"), (3, "c", "http://c", "a sea of rain and a long tale that goes on")], "page_id long, title string, url string, text string")
    search = TableSearch(pages)
    assert [r["url"] for r in search.search("sea").collect()] == ["http://b", "http://c"] and search.search("se").count() == 0


def test_fused(spark):
    side = lambda ids: spark.createDataFrame([(1, i, k) for k, i in enumerate(ids, 1)], "question long, doc_id long, rank int")
    assert [r["doc_id"] for r in K.fused([side([5, 6, 7]), side([6, 8])], "doc_id", 3).orderBy("rank").collect()] == [6, 5, 8]


def test_pages_go_on_from_the_last_key(spark):
    rows = [(k, None if k % 7 == 0 else f"t{k % 5}") for k in range(50)]
    books = spark.createDataFrame(rows, "book_id int, title string")
    want = [r["book_id"] for r in books.orderBy("title", "book_id").collect()]
    got, page = [], None
    while page is None or page.last is not None:
        page = R.page_after(books, 8, page and page.last)
        got += [r["book_id"] for r in page.rows.collect()]
        assert page.total == 50
    assert got == want
    none = R.page_after(books.limit(0), 8)
    assert (none.total, none.last, none.rows.count()) == (0, None, 0)


def test_files_of_one_name_are_numbered_by_many_tasks(spark):
    files = spark.range(1000).select(F.lit("Index.epub").alias("file_name"), F.format_string("d%05d/Index.epub", F.pmod(F.col("id") * 7919, F.lit(1000))).alias("path"))
    found = B.numbered(files)
    assert {r["path"]: r["place"] for r in found.collect()} == {f"d{k:05d}/Index.epub": k + 1 for k in range(1000)}
    dealt = files.repartitionByRange(4, F.lower("file_name"), F.col("path")).groupBy(F.spark_partition_id()).count()
    assert dealt.count() > 1 and dealt.agg(F.max("count")).first()[0] < 700
    assert B.numbered(files.limit(0)).count() == 0 and B.positions(files.limit(3)).agg(F.max("mark")).first()[0] == "[3/3]"


def test_files_without_a_name_are_last_and_equal_paths_go_by_their_key(spark):
    rows = [(5, None), (9, "b"), (2, "B"), (7, "a"), (1, "b"), (4, "b"), (3, None)]
    files = spark.createDataFrame(rows, "id long, path string").withColumn("file_name", F.col("path")).repartition(3)
    want = [7, 2, 1, 4, 9, 3, 5]
    assert {r["id"]: r["mark"] for r in B.positions(files, ("id",)).collect()} == {i: f"[{k}/7]" for k, i in enumerate(want, 1)}


def moved(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_postings_are_written_without_moving_and_repeated_ids_are_one_document(spark, tmp_path):
    docs = spark.createDataFrame([(1, "b a b"), (1, "a c c"), (2, "A"), (3, None), (4, "")], "doc_id long, text string")
    index = K.KeywordIndex(spark, str(tmp_path / "index")).build(docs)
    assert index.stats() == {"documents": 5, "mean_length": 7 / 5}
    found = sorted((r["term"], r["doc"]) for r in index.postings().collect())
    assert found == [("a", 1), ("a", 2), ("b", 1), ("c", 1)]
    own, n, mean = index.measured(docs.filter("doc_id > 1"), "text")
    assert (n, mean, moved(own)) == (3, 1 / 3, 0) and own.collect() == [("a", 2, 1, 1)]
    want = sorted(map(tuple, index.terms().collect()))
    assert sorted(map(tuple, K.KeywordIndex(spark, str(tmp_path / "none")).vocabulary(docs).collect())) == want and not (tmp_path / "none").exists()


def test_skipping_still_changes_nothing(spark, index):
    questions = spark.createDataFrame([(1, "the0 the1 word7"), (2, "word9 word8"), (3, "the4")], "question long, text string")
    rows = lambda **how: sorted((r["question"], r["rank"], r["doc_id"], round(r["score"], 8)) for r in index.search_each(questions, 5, **how).collect())
    assert rows(skip=True) == rows(skip=False)


def test_pages_are_read_once(spark):
    html = ["<title>t &amp; u</title><p>a</p> b", "<h1> </h1><script>x</script>", "", None]
    both = spark.createDataFrame([(x,) for x in html], "html string").select(markup.html_parts(F.col("html")).alias("p"), markup.html_title(F.col("html")).alias("title"), markup.html_to_text(F.col("html")).alias("text"))
    assert all((r["p"]["title"], r["p"]["text"]) == (r["title"], r["text"]) for r in both.collect())
