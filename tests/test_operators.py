"""Edge cases of the operators on small tables."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quireflow.functions import model_output as M
from quireflow.functions import text as T
from quireflow.functions import vector as V
from quireflow.functions.filters import matching, predicate
from quireflow.operators import analysis as A
from quireflow.operators import batch as B
from quireflow.operators import chapters as C
from quireflow.operators import chunking as K
from quireflow.operators import embedding as E
from quireflow.operators import retrieval as R
from quireflow.operators import serving as S
from quireflow.sources import markup, pdf


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_text_functions(spark):
    lit = F.lit
    assert value(spark, T.strip(lit("  a b\x1c\n"))) == "a b"
    assert [value(spark, T.token_estimate(lit(x))) for x in ("", "abc", "abcd", "é" * 9)] == [0, 0, 1, 2]
    assert value(spark, T.word_count(lit(" a b \n"))) == 2 and value(spark, T.word_count(lit(""))) == 0
    assert (value(spark, T.clip(lit("abc"), 3)), value(spark, T.clip(lit("abcd"), 3))) == ("abc", "abc...")
    assert [value(spark, T.split_names(lit(x))) for x in ("A, B;C", "A ; B", "A", "")] == [["A", "B;C"], ["A", "B"], ["A"], []]
    assert [value(spark, T.pdf_date(lit(x))) for x in ("D:2020", "D:202005", "D:20200517101112Z", "junk", "")] == ["2020-01-01", "2020-05-01", "2020-05-17", None, None]
    assert [len(value(spark, T.parts(F.repeat(lit("x"), lit(n))))) for n in (0, 3500, 3501, 6000, 6001)] == [1, 1, 2, 2, 3]
    assert value(spark, T.citation(lit("B"), lit("C"), lit(None).cast("int"), lit(2))) == "[2] B, C"
    assert value(spark, T.without_mention(lit("<@U1> hi <@U2>"))) == "hi"
    assert value(spark, T.chapter_line(lit("One"), lit(7))) == "- One (7 words)"
    assert value(spark, T.file_stem(lit("a/b.c/My Book.v2.epub"))) == "My Book.v2"


def test_isbn(spark):
    row = lambda *x: F.array(*[F.struct(F.lit(s).cast("string").alias("scheme"), F.lit(v).alias("value")) for s, v in x])
    found = spark.range(1).select(*T.isbn_columns(row(("ISBN", "0-306-40615-x"), (None, "urn:isbn:9780306406157"), ("isbn", "123456789012"), ("doi", "1234567890")))).first()
    assert tuple(found) == ("030640615X", "9780306406157")


def test_filters_treat_missing_as_no_match(spark):
    df = spark.createDataFrame([(1, ["a", None], "x"), (2, ["b"], None), (3, None, "y")], "id int, tags array<string>, kind string")

    def ids(f):
        found = [r["id"] for r in df.filter(predicate(df, f)).orderBy("id").collect()]
        assert found == [r["id"] for r in matching(df, f).orderBy("id").collect()]
        return found

    assert ids(None) == ids({}) == [1, 2, 3]
    assert ids({"tags": ["b", "z"]}) == [2] and ids({"tags": "a"}) == [1] and ids({"tags": []}) == []
    assert ids({"kind": ["x", "y"]}) == [1, 3] and ids({"kind": "x", "tags": ["a", "b"]}) == [1]
    assert [r["id"] for r in df.filter(~predicate(df, {"kind": "x"})).collect()] == [2, 3]


def test_cosine(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2, 20, 8))
    df = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()]
    assert np.allclose(got, (a * b).sum(1) / np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1), atol=1e-6)
    assert value(spark, V.cosine(V.query_vector([0.0, 0.0]), V.query_vector([1.0, 0.0]))) == 0.0
    assert abs(value(spark, V.cosine(V.query_vector([1.0, 2.0]), V.query_vector([-1.0, -2.0]))) + 1) < 1e-12
    with pytest.raises(Exception, match="expected 3 dimensions"):
        value(spark, V.checked_dimension(V.query_vector([1.0]), 3))
    ties = spark.createDataFrame([(k, [1.0, 0.0]) for k in (3, 1, 2)], "chunk_index int, embedding array<float>")
    assert [r["chunk_index"] for r in R.top_k(ties, [1.0, 0.0], 2).collect()] == [1, 2]


def by_hand(text, size, overlap, separators):
    """The published algorithm of recursive splitting, written down once more and plainly."""

    def merge(pieces):
        out, held = [], []
        for piece in pieces:
            n = K.estimate(piece)
            if held and sum(map(K.estimate, held)) + n > size:
                out.append("".join(held).strip())
                while held and (sum(map(K.estimate, held)) > overlap or (sum(map(K.estimate, held)) + n > size and sum(map(K.estimate, held)) > 0)):
                    held = held[1:]
            held = [*held, piece]
        out.append("".join(held).strip())
        return [x for x in out if x]

    for k, sep in enumerate(separators):
        if sep == "" or sep in text:
            break
    parts = list(text) if sep == "" else [text.split(sep)[0], *(sep + x for x in text.split(sep)[1:])]
    out, good = [], []
    for part in filter(None, parts):
        if K.estimate(part) < size:
            good.append(part)
        else:
            if good:
                out += merge(good)
                good = []
            out += by_hand(part, size, overlap, separators[k + 1 :]) if separators[k + 1 :] else [part]
    return out + (merge(good) if good else [])


prose = st.lists(st.sampled_from(["word", "longerword", "a", "no", ". ", "! ", "; ", ", ", " ", " ", "\n", "\n\n", "\n\n\n", "x" * 90]), max_size=120).map("".join)


@settings(max_examples=200, deadline=None)
@given(prose, st.integers(4, 30), st.integers(0, 8))
def test_splitter(text, size, overlap):
    chunks = K.split(text, size, min(overlap, size - 1))
    assert chunks == by_hand(text, size, min(overlap, size - 1), K.SEPARATORS)
    assert all(c and c == c.strip() and c in text for c in chunks)
    if text.strip() and K.estimate(text) < size:
        assert chunks == [text.strip()] or len(chunks) == 1


def test_chunk_filter_spares_the_last(spark):
    df = spark.createDataFrame([(1, "x" * 64 + "\n\n\n" + "y" * 9 + "\n\n\n" + "z" * 61), (2, "tiny"), (3, " \n "), (4, None)], "k int, content string")
    rows = K.recursive(df, ["k"], min_tokens=7, max_tokens=29, overlap=0.0, compat=False).orderBy("k", "position").collect()
    assert [(r["k"], r["content"][0]) for r in rows] == [(1, "x"), (1, "z"), (2, "t")] and rows[1]["position"] == 2
    assert K.sizes(500, 2000, 0.2, True) == (5000, 1000) and K.sizes(500, 2000, 0.2, False) == (1250, 250)
    stats = K.statistics(spark.createDataFrame([], "token_count long")).first()
    assert tuple(stats) == (0, 0, 0, 0, 0)


def test_books_without_chapters_are_chunked_whole(spark):
    books = spark.createDataFrame([("a", "whole text of a"), ("b", "whole text of b")], "book_id string, raw_text string")
    chapters = spark.createDataFrame([("a", 1, "One", 0, 0, "chapter one of a"), ("a", 2, "Two", 3, 4, "chapter two of a")], "book_id string, number int, title string, start_page int, end_page int, content string")
    rows = K.chunk_books(books, chapters, min_tokens=1, max_tokens=50).orderBy("book_id", "chunk_index").collect()
    assert [(r["book_id"], r["chunk_index"], r["source_type"], r["start_page"], r["total_document_chunks"]) for r in rows] == [("a", 0, "chapter", None, 2), ("a", 1, "chapter", 3, 2), ("b", 0, "full_document", None, 1)]
    assert K.chunk_books(books, chapters, preserve_structure=False, min_tokens=1, max_tokens=50).count() == 2


def test_pdf_chapters(spark):
    pages = spark.createDataFrame([("p", k, f"page {k} " + "t" * 60) for k in range(1, 9)] + [("q", 1, "only"), ("q", 2, "two")], "book_id string, page int, text string")
    toc = spark.createDataFrame([("p", 0, 1, "A", 1), ("p", 1, 3, "deep", 3), ("p", 2, 1, "B", 4), ("p", 3, 2, "same", 4), ("p", 4, 1, "C", 7)], "book_id string, seq int, level int, title string, page int")
    rows = pdf.chapters(pages, toc).orderBy("book_id", "number").collect()
    assert [(r["book_id"], r["number"], r["title"], r["start_page"], r["end_page"]) for r in rows] == [("p", 1, "A", 1, 2), ("p", 2, "same", 4, 6), ("p", 3, "C", 7, 8), ("q", 1, "Full Document", 1, 2)]
    assert rows[3]["content"] == "only\ntwo" and rows[0]["content"].startswith("page 1 ")
    books = spark.createDataFrame([("x.pdf", "p", 8, {"title": "", "author": "A; B", "creationDate": "D:201901"})], "path string, book_id string, page_count int, info map<string,string>")
    meta = pdf.metadata(books).first()
    assert (meta["title"], meta["authors"], meta["date"], meta["subjects"]) == ("x", ["A", "B"], "2019-01-01", [])
    listed = pdf.contents(spark.createDataFrame([("p", [(0, 1, "A", 1), (1, 3, "B", 2)])], "book_id string, toc array<struct<seq: int, level: int, title: string, page: int>>"))
    assert [tuple(r) for r in listed.orderBy("seq").collect()] == [("p", 0, 0, "A", 1), ("p", 1, 2, "B", 2)]
    seen = pdf.images(spark.createDataFrame([("p", [(0, 7, "png", 60, 60, 2), (1, 7, "png", 60, 60, 1), (2, 8, "jpeg", 49, 60, 1)])], "book_id string, images array<struct<ord: int, xref: int, ext: string, width: int, height: int, page_number: int>>"))
    assert [(r["filename"], r["content_type"]) for r in seen.collect()] == [("page1_img7.png", "image/png")]
    files = spark.createDataFrame([("x.pdf", bytearray(b"no"))], "path string, content binary")
    assert pdf.read(files).first()["status"] == "failed"


def test_images_of_chapters(spark):
    chapters = spark.createDataFrame([("b", 1, 1, 2, "one"), ("b", 2, 3, 4, "two"), ("b", 3, None, None, "none")], "book_id string, number int, start_page int, end_page int, content string")
    images = spark.createDataFrame([("b", 0, 2, "photo", "cat", ""), ("b", 1, 1, "chart", "bars", "x" * 600), ("b", 2, 0, "photo", "zero", ""), ("b", 3, None, "photo", "null", ""), ("b", 4, 9, "photo", "out", "")], "book_id string, ord int, page_number int, image_type string, description string, ocr_text string")
    rows = C.with_images(chapters, images, ["book_id"]).orderBy("number").collect()
    assert [r["n_images"] for r in rows] == [2, 0, 0]
    assert rows[0]["content"] == "one\n\n[Image Context]\n[CHART] bars\nText: " + "x" * 500 + "\n\n[PHOTO] cat" and rows[1]["content"] == "two"


def test_concepts(spark):
    rows = [(1, 0, "Alpha", "short"), (1, 1, " alpha ", "a longer one"), (1, 2, "ALPHA", "a longer 1ne"), (1, 3, "  ", "blank"), (1, 4, "beta", "b")] + [(2, k, f"t{k}", "d") for k in range(31)]
    found = A.distinct_concepts(spark.createDataFrame(rows, "book int, pos int, term string, definition string"), ["book"]).orderBy("book", "ord").collect()
    assert [(r["ord"], r["term"], r["definition"]) for r in found if r["book"] == 1] == [(1, " alpha ", "a longer one"), (2, "beta", "b")]
    assert len([r for r in found if r["book"] == 2]) == 30


def test_answers(spark):
    class Odd:
        def analyze(self, agent, text):
            if text == "fail":
                raise RuntimeError("no model")
            return {"lead": 'Sure: {"genres": "one", "tags": [" a ", "", "b"], "difficulty_level": "expert"}', "tail": '{"genres": []} thanks', "list": '{"genres": ["1","2","3","4"], "target_audience": null}'}[text]

    calls = spark.createDataFrame([(t, "genre_tags", t) for t in ("fail", "lead", "tail", "list")], "book_id string, agent string, input string")
    rows = A.normalised(A.answered(calls, Odd(), attempts=2, wait_s=0.0))
    assert {r["book_id"]: r["status"] for r in rows.collect()} == {"fail": "exception", "lead": "ok", "tail": "parse_error", "list": "ok"}
    found = {r["book_id"]: r for r in A.form(rows, "genre_tags").collect()}
    assert (found["lead"]["genres"], found["lead"]["tags"], found["lead"]["difficulty_level"], found["lead"]["target_audience"]) == (["one"], ["a", "b"], "expert", "general")
    assert (found["tail"]["difficulty_level"], found["fail"]["difficulty_level"], found["fail"]["genres"]) == ("intermediate", "", [])
    assert found["list"]["genres"] == ["1", "2", "3"] and found["list"]["target_audience"] == "general"
    with pytest.raises(ValueError, match="unknown agent"):
        A.form(rows, "none")


def test_theme_forms(spark):
    raw = '{"primary_themes": [{"name": "a", "description": "d"}, "b", 3, {"x": 1}, null], "secondary_themes": "no list"}'
    v = M.parsed(F.lit(raw))
    assert [tuple(x) for x in value(spark, M.themes_at(v, "primary_themes", 5))] == [("a", "d"), ("b", ""), ("Unknown", "")]
    assert value(spark, M.themes_at(v, "secondary_themes", 4)) == []
    assert (value(spark, M.ocr_text(F.lit(" No_Text "))), value(spark, M.image_class(F.lit(" Chart\n")))) == ("", "chart")


def test_images_from_answers(spark):
    images = spark.createDataFrame([("b", 0, "i.png", 60, 60, 1), ("b", 1, "j.png", 60, 60, 2)], "book_id string, ord int, filename string, width int, height int, page_number int")
    rows = spark.createDataFrame([("b", 0, "describe", "a cat"), ("b", 0, "ocr", "NO_TEXT"), ("b", 0, "classify", " Photo ")], "book_id string, ord int, agent string, answer string")
    found = A.image_descriptions(images, rows).orderBy("ord").collect()
    assert [(r["description"], r["ocr_text"], r["image_type"]) for r in found] == [("a cat", "", "photo"), ("", "", "unknown")]


def test_embedding(spark):
    model = E.HashingEmbedder(16)
    df = spark.createDataFrame([(1, "the cat"), (2, ""), (3, None)], "k int, content string")
    rows = {r["k"]: r["embedding"] for r in E.embed_chunks(df, model).collect()}
    assert np.allclose(rows[1], E.embed_query("the cat", model)) and not any(rows[2]) and not any(rows[3])
    with pytest.raises(Exception, match="no vector for 2"):
        E.joined(df, spark.createDataFrame([(1, [1.0]), (3, [1.0])], "k int, embedding array<float>"), "k").collect()


def test_intents(spark):
    said = ["my checkouts", "return the book X", "read chapter 3", "please read chapter 3", "helpful", "borrow it", "tell me about Dune", "what is love", "show my books", "gimme it", "Let's talk about Dune", "focus on mud, tell me about Dune"]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(said)], "k int, m string")
    known = lambda title: title == "dune"
    got = lambda book, by: [r[0] for r in df.orderBy("k").select(S.intent(F.col("m"), F.lit(book), by)).collect()]
    assert got(False, known) == ["checkout", "return_book", "read_chapter", "search", "help", "search", "focus_book", "search", "list_checkouts", "recommend", "focus_book", "focus_book"]
    assert got(True, lambda title: F.lit(False))[6:8] == ["book_question", "book_question"]
    assert value(spark, S.title_asked(F.lit("Please focus on The Sea "), lambda t: F.lit(True))) == "the sea" and value(spark, S.chapter_asked(F.lit("Read chapter 12"))) == 12


def test_ledger(spark, tmp_path):
    ledger, at = S.Ledger(spark, str(tmp_path / "loans")), lambda d: dt.datetime(2024, 3, d, 12)
    ledger.check_out("b", "u", at(1))
    ledger.check_out("b", "v", at(2))
    ledger.check_out("c", "u", at(9))
    assert ledger.give_back("b", "u", at(5)) == 1 and ledger.give_back("b", "u", at(6)) == 0 and ledger.give_back("x", "u", at(6)) == 0
    state = lambda d: {(r["book_id"], r["user_id"]): (r["status"], r["return_time"]) for r in ledger.state(F.lit(at(d)).cast("timestamp_ntz")).collect()}
    assert state(10) == {("b", "u"): ("returned", at(5)), ("b", "v"): ("active", None), ("c", "u"): ("active", None)}
    assert state(20) == {("b", "u"): ("returned", at(5)), ("b", "v"): ("auto-returned", at(20)), ("c", "u"): ("active", None)}
    ledger.check_out("b", "u", at(21))
    assert state(22)["b", "u"] == ("active", None) and ledger.events().count() == 5


def test_ledger_is_empty_ties_and_races(spark, tmp_path, monkeypatch):
    from quireflow.operators import commits

    ledger, at = S.Ledger(spark, str(tmp_path / "loans")), dt.datetime(2024, 3, 1, 12)
    status = lambda: {(r["book_id"], r["user_id"]): r["status"] for r in ledger.state(F.lit(at).cast("timestamp_ntz")).collect()}
    assert ledger.give_back("b", "u", at) == 0 and status() == {} and ledger.events().count() == 0
    ledger.check_out("b", "u", at)
    assert ledger.give_back("b", "u", at) == 1 and status() == {("b", "u"): "returned"}  # the same moment: the later event counts
    ledger.check_out("b", "u", at)
    assert status() == {("b", "u"): "active"}
    other, real, done = S.Ledger(spark, ledger.path), commits.write_new, []

    def late(*a):
        if not done:
            done.append(1)
            assert other.give_back("b", "u", at) == 1  # between this writer's look and its commit
        return real(*a)

    monkeypatch.setattr(commits, "write_new", late)
    assert ledger.give_back("b", "u", at) == 0 and ledger.events().filter("status = 'returned'").count() == 2
    monkeypatch.setattr(commits, "write_new", real)
    monkeypatch.setattr(S.Ledger, "TAIL", 2)
    for k in range(5):
        ledger.check_out("c", f"u{k}", at)
    held = ledger.log.state()
    assert held["snapshot"] and len(held["tail"]) <= 3 and ledger.events().count() < 9
    assert status() == {("b", "u"): "returned"} | {("c", f"u{k}"): "active" for k in range(5)}
    ledger.vacuum(1)
    assert len(status()) == 6 and len(ledger.log.versions()) == 1


def test_web_gate(spark):
    rows = [("old tale", 0.9, False), ("old tale", 0.4, True), ("old tale", None, True), ("the LATEST tale", 0.9, True), ("how to read", 0.9, True), ("trending today online", 0.9, False), (None, 0.9, False)]
    df = spark.createDataFrame(rows, "m string, best double, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", R.needs_web(F.col("m"), F.col("best")).alias("got")).collect())


def test_recommended_takes_twice_as_many_candidates_and_the_models_order(spark):
    rows = [(k, True, [1.0, k / 10], ["sea"] if k != 1 else ["war"]) for k in range(6)] + [(9, False, [1.0, 0.0], ["sea"])]
    points = spark.createDataFrame(rows, "book_id int, is_metadata boolean, embedding array<float>, tags array<string>")
    chosen = spark.createDataFrame([(4, 1), (0, 2), (5, 3)], "book_id int, rank int")
    found = lambda **how: [r["book_id"] for r in R.recommended(points, [1.0, 0.0], 2, **how).collect()]
    assert found() == [0, 1] and found(tags=["sea"]) == [0, 2] and found(tags=["sea"], chosen=chosen) == [4, 0]
    assert R.wanted_tags("gimme sea, and machine learning", ["Sea", "sea food", "machine learning", ""]) == ["Sea", "machine learning"]


def test_loans(spark):
    now, at = dt.datetime(2024, 3, 20, 12), lambda d, h: dt.datetime(2024, 3, d, h)
    df = spark.createDataFrame([("b", "u", at(6, 12), None, "active", None), ("b", "v", at(6, 11), None, "active", None), ("c", "u", at(1, 0), at(30, 0), "active", None), ("c", "v", at(1, 0), at(2, 0), "returned", at(2, 0))], "book_id string, user_id string, checkout_time timestamp_ntz, expiry_time timestamp_ntz, status string, return_time timestamp_ntz")
    when = F.lit(now).cast("timestamp_ntz")
    rows = {(r["book_id"], r["user_id"]): r for r in S.auto_returned(S.loans(df, when), when).collect()}
    assert [rows[k]["days_left"] for k in (("b", "u"), ("b", "v"), ("c", "u"))] == [0, -1, 9]
    assert {k: r["status"] for k, r in rows.items()} == {("b", "u"): "active", ("b", "v"): "auto-returned", ("c", "u"): "active", ("c", "v"): "returned"}
    assert rows["b", "v"]["return_time"] == now
    titles = S.titled(df, spark.createDataFrame([("b", "Bee")], "book_id string, title string")).select("book_id", "title").distinct()
    assert {tuple(r) for r in titles.collect()} == {("b", "Bee"), ("c", "Unknown Book")}


def test_batches(spark):
    files = spark.createDataFrame([(f"d/{n}", n) for n in ("b.epub", "A.epub", "c.pdf")], "path string, file_name string")
    done = spark.createDataFrame([("d/A.epub", "failed", "x"), ("d/b.epub", "completed", None)], "path string, status string, error string")
    names = lambda df: sorted(r["file_name"] for r in df.collect())
    assert names(B.remaining(files, done)) == ["c.pdf"] and names(B.remaining(files, done, 2)) == [] and names(B.remaining(files, done, retry_failed=True)) == ["A.epub", "c.pdf"]
    counts = B.with_rates(B.counters(done), F.lit(4), F.lit(60.0)).first()
    assert (counts["processed_files"], counts["failed_files"], counts["percent"], counts["eta_minutes"]) == (2, 1, 50.0, 1.0)
    none = B.with_rates(B.counters(done.limit(0)), F.lit(0), F.lit(0.0)).first()
    assert (none["percent"], none["files_per_minute"], none["eta_minutes"]) == (0.0, 0.0, 0.0)
    assert [B.exit_code(0), B.exit_code(2), B.exit_code(0, True)] == [0, 1, 130]


def test_markup():
    page = "<html><head><title>T</title><script>no</script></head><body><!-- c --><h1> Head </h1><p>a <b>b</b></p><img src='x.png'></body>"
    found = markup.read(page)
    assert (found.title, found.images, markup.text_of(page)) == ("T", ["x.png"], "T\nHead\na\nb") and markup.text_of(None) == ""


def test_hybrid_and_web(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "cats"), (2, [0.9, 0.1], "dogs"), (3, [0.0, 1.0], None)], "chunk_index int, embedding array<float>, content string")
    assert R.hybrid(rows, [1.0, 0.0], ["dogs"], weight=0.5).first()["chunk_index"] == 2
    both = R.context(rows.select("chunk_index", "content"), spark.createDataFrame([("http://x",)], "url string"))
    assert both.columns == ["chunk_index", "content", "source", "url"] and both.count() == 4


def test_plans(spark, capsys):
    """Filters and columns reach the scan, and a top-k sorts nothing but what each task keeps."""
    folder = "/root/testdata/sf0.001"
    found = R.top_k(spark.read.parquet(f"{folder}/embeddings.parquet"), [0.1] * 64, 10, {"label": [1, 3]}, "vec_id")
    found.select("vec_id", "score").explain("formatted")
    plan = capsys.readouterr().out
    assert "TakeOrderedAndProject" in plan and "PushedFilters: [In(label, [1,3])]" in plan
    S.last_messages(spark.read.parquet(f"{folder}/conversations.parquet"), "conv_id", "turn").select("conv_id", "turn").explain("formatted")
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint>" in plan and "WindowGroupLimit" in plan


def test_chunks_leave_a_worker_in_bounded_batches(spark):
    texts = [" ".join(f"w{i}x{k}" for k in range(3000)) for i in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(202)), pa.array([*texts, None, " "])], names=["id", "text"])
    size, shared = K.sizes(20, 80, 0.2, True)
    found = list(K.cutter(["id"], size, shared, K.estimate)(iter([batch])))
    assert len(found) > 2 and max(b.nbytes for b in found) < 2 * K.CHARS_AT_ONCE
    rows = [r for b in found for r in b.to_pylist()]
    assert [(r["id"], r["position"], r["n_raw"], r["content"]) for r in rows] == [(i, k, len(c), x) for i, t in enumerate(texts) for c in [K.split(t, size, shared)] for k, x in enumerate(c)]


def test_workers_get_short_batches_of_texts(spark):
    name, rows = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.createDataFrame([(1, "a b")], "id long, content string")
    for make in (lambda: K.recursive(rows, ["id"]), lambda: E.embed_chunks(rows, E.HashingEmbedder(8))):
        spark.conf.set(name, "10000")
        make()
        assert int(spark.conf.get(name)) <= 512


def test_agents_that_read_every_chapter_need_no_window(spark):
    from quireflow.operators import analysis as A

    chapters = spark.createDataFrame([("a", k, f"Chapter {k}", f"text {k}") for k in range(1, 13)], "book_id string, number int, title string, content string")
    whole = A.chapter_windows(chapters, ("chapter_summary",))
    assert whole.count() == 12 and "Window" not in whole._jdf.queryExecution().executedPlan().toString()
    assert {(r["agent"], r["count"]) for r in A.chapter_windows(chapters).groupBy("agent").count().collect()} == {("chapter_summary", 12), ("key_quotes", 10), ("technical_concepts", 8)}
