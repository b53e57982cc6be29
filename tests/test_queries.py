"""Every query with SQL gives the same rows as DuckDB on the same tables."""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import duckdb
import numpy as np
import pandas as pd
import pytest

from quireflow.operators.analysis import WordAnalyzer
from quireflow.plans.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    own = duckdb.connect()
    for name in TABLES:
        own.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return own


def plain(df: pd.DataFrame) -> pd.DataFrame:
    columns = sorted(df.columns)

    def one(v) -> str:
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        return str(float(v)) if isinstance(v, (int, float)) or "int" in type(v).__name__ or "float" in type(v).__name__ else str(v)

    return df[columns].map(one).sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got, want = plain(QUERIES[name](spark, FOLDER).toPandas()), plain(duck.execute(ORACLES[name]).df())
    pd.testing.assert_frame_equal(got, want)
    assert len(got) or name == "vec_threshold_match"


def rows_of(spark, table: str) -> list:
    return spark.read.parquet(f"{FOLDER}/{table}.parquet").collect()


def vector(text: str, size: int = 64) -> np.ndarray:
    """Signed word hashes, scaled to length 1."""
    out = np.zeros(size)
    for word, n in Counter((text or "").lower().split()).items():
        h = zlib.crc32(word.encode())
        out[h % size] += n if h >> 31 else -n
    return out / np.linalg.norm(out) if out.any() else out


def test_embed_documents(spark):
    want = {r["doc_id"]: vector(r["text"]) for r in rows_of(spark, "documents")}
    found = {r["doc_id"]: r["embedding"] for r in QUERIES["embed_documents"](spark, FOLDER).collect()}
    assert set(found) == set(want) and all(np.allclose(found[i], want[i], atol=1e-6) for i in want)


def test_semantic_search_text(spark):
    texts = {r["doc_id"]: r["text"] for r in rows_of(spark, "documents")}
    vectors = {i: vector(t) for i, t in texts.items()}
    got: dict = {}
    for r in QUERIES["semantic_search_text"](spark, FOLDER).collect():
        got.setdefault(r["question"], {})[r["rank"]] = r
    items = rows_of(spark, "benchmark")
    assert set(got) == {r["item_id"] for r in items}
    for item in items:
        question = vector(item["text"])
        best = sorted((round(float(v @ question), 5) for v in vectors.values()), reverse=True)[:5]
        found = [got[item["item_id"]][k] for k in range(1, 6)]
        assert np.allclose([r["score"] for r in found], best, atol=2e-5)
        assert all(abs(float(vectors[r["doc_id"]] @ question) - r["score"]) < 2e-5 and r["content_preview"] == texts[r["doc_id"]][:100] + "..." for r in found)


class Plain(HTMLParser):
    """Text pieces by the standard parser: each stripped, without scripts and styles."""

    def __init__(self, page: str):
        super().__init__()
        self.pieces, self.mute = [], 0
        self.feed(page or "")
        self.close()

    def handle_starttag(self, tag, attrs):
        self.mute += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.mute -= tag in ("script", "style") and self.mute > 0

    def handle_data(self, data):
        if not self.mute and data.strip():
            self.pieces.append(data.strip())


def test_html_text(spark):
    want = {r["page_id"]: "\n".join(Plain(r["html"]).pieces) for r in rows_of(spark, "pages")}
    assert {r["page_id"]: r["text"] for r in QUERIES["html_text"](spark, FOLDER).collect()} == want


def test_web_hits(spark):
    """BM25 over whole words, written down once more."""
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    rows = {r["url"]: (r["page_id"], "\n".join(Plain(r["html"]).pieces)) for r in rows_of(spark, "pages")}
    counts = {u: Counter(words(t)) for u, (_, t) in rows.items()}
    df = Counter(w for c in counts.values() for w in c)
    n, mean = len(rows), sum(sum(c.values()) for c in counts.values()) / len(rows)
    got: dict = {}
    for r in QUERIES["web_hits"](spark, FOLDER).collect():
        got.setdefault(r["question"], []).append((r["rank"], r["url"], r["snippet"]))
    for item in rows_of(spark, "benchmark"):
        asked = Counter(words(item["text"]))
        score = {u: sum(k * np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w, k in asked.items() if c[w]) for u, c in counts.items()}
        best = sorted((u for u in score if score[u] > 0), key=lambda u: (-round(score[u], 9), rows[u][0]))[:5]
        assert sorted(got.get(item["item_id"], [])) == [(k, u, rows[u][1][:200]) for k, u in enumerate(best, 1)]


def chapters_of(spark) -> dict[str, list[tuple[int, str]]]:
    books: dict = {}
    for r in sorted(rows_of(spark, "documents"), key=lambda r: r["doc_id"]):
        own = books.setdefault(f"{r['lang']}/{r['source']}", [])
        own.append((len(own) + 1, r["text"]))
    return books


def test_analyze_chapters(spark):
    """Concepts of the first eight chapters of each book, by the analyzer itself, reduced to distinct terms."""
    want = {}
    for book, chapters in chapters_of(spark).items():
        best: dict = {}
        for number, text in chapters[:8]:
            for k, c in enumerate(json.loads(WordAnalyzer().analyze("technical_concepts", text[:12000]))["concepts"]):
                term = c["term"].strip().lower()
                first, _, held = best.get(term, ((number, k), 0, None))
                if held is None or len(c["definition"]) > len(held):
                    held = c["definition"]
                best[term] = (first, 0, held)
        for at, (term, x) in enumerate(sorted(best.items(), key=lambda y: y[1][0])[:30], 1):
            want[book, at] = (term, x[2])
    found = {(r["book_id"], r["ord"]): (r["term"].lower(), r["definition"]) for r in QUERIES["analyze_chapters"](spark, FOLDER).collect()}
    assert found == want


def test_analyze_books(spark):
    books = chapters_of(spark)
    found = {r["book_id"]: r for r in QUERIES["analyze_books"](spark, FOLDER).collect()}
    assert set(found) == set(books)
    clip = lambda text, n: text if len(text) <= n else text[:n] + "..."
    for book, chapters in books.items():
        r, sample = found[book], lambda n, limit: "\n\n---\n\n".join(f"## Chapter {k}\n\n{clip(text, limit)}" for k, text in chapters[:n])  # noqa: B023
        genre, whole, themes = (json.loads(WordAnalyzer().analyze(agent, sample(n, 8000))) for agent, n in (("genre_tags", 3), ("overview", 5), ("themes", 5)))
        assert (r["genres"], r["tags"], r["summary"], r["main_topics"]) == (genre["genres"][:3], genre["tags"][:10], whole["summary"], whole["main_topics"][:10])
        assert r["themes"] == [x["name"] for x in themes["primary_themes"]]
        quotes = [(q["text"], f"Chapter {k}") for k, text in chapters[:10] for q in json.loads(WordAnalyzer().analyze("key_quotes", text[:12000]))["quotes"] if q["text"]]
        assert [(q["text"], q["chapter"]) for q in r["key_quotes"]] == quotes[:15]
        assert [(x["number"], x["summary"]) for x in r["chapter_summaries"]] == [(k, json.loads(WordAnalyzer().analyze("chapter_summary", text[:15000]))["summary"]) for k, text in chapters]
        assert len(r["technical_concepts"]) <= 30


CHECKED = {"embed_documents", "semantic_search_text", "html_text", "web_hits", "analyze_chapters", "analyze_books"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - CHECKED))
def test_without_sql_there_are_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_base64_takes_whole_texts(spark):
    import base64

    texts = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = {r["doc_id"]: r["b64_chars"] for r in QUERIES["base64_whole"](spark, FOLDER).collect()}
    assert found == {i: len(base64.b64encode(t)) for i, t in texts.items()} and max(found.values()) > 76


def test_html_title_is_what_its_sql_says(spark, duck, tmp_path):
    inner = ["a &amp;&amp", "&quot;b&quot; &#39;c&#39;", "&amp;lt; &nbsp;", " \t\n d\r\f", "\u00a0e\x0b", "<b>f</b> g", "", "h<br/>i\nj", "&lt;x&gt;"]
    html = [f"<html><H1 class='t'\n>{x}</h1><title>later</title>" for x in inner] + ["<title>never closed", "<p>none</p>", "<script><h2>k</h2></script>", "<h10>l</h10>", "<TITLE>m</TITLE >", "", None]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    own = duckdb.connect()
    own.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = dict(own.execute(ORACLES["html_title"]).fetchall())
    assert {r["page_id"]: r["title"] for r in QUERIES["html_title"](spark, str(tmp_path)).collect()} == want
    assert want[0] == "a &&amp" and want[5] == "<b>f"
