"""Files to search results, resuming, replacing and deleting."""

from __future__ import annotations

import io
import struct
import zipfile

import pytest

from quireflow import cli
from quireflow.config import Config
from quireflow.library import Library
from quireflow.operators import analysis as A
from quireflow.sources import epub, files


def png(width: int, height: int) -> bytes:
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", width, height) + bytes(20)


def book(title: str, chapters: list[tuple[str, str]], identifiers: str = "") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
        items = "".join(f'<item id="c{k}" href="c{k}.xhtml" media-type="application/xhtml+xml"/>' for k in range(len(chapters)))
        items += '<item id="i" href="a.png" media-type="image/png"/><item id="j" href="b.png" media-type="image/png"/><item id="x" href="bad.png" media-type="image/png"/><item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/>'
        z.writestr("OPS/p.opf", f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf"><metadata><dc:title>{title}</dc:title><dc:creator>Ann</dc:creator><dc:creator>Bob</dc:creator><dc:description>&lt;p&gt;All of it&lt;/p&gt;</dc:description>{identifiers}</metadata><manifest>{items}</manifest></package>')
        z.writestr("OPS/toc.ncx", '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>One</text></navLabel><content src="c0.xhtml"/><navPoint><navLabel><text>Deep</text></navLabel><content src="c0.xhtml#d"/></navPoint></navPoint><navPoint><navLabel><text>Two</text></navLabel><content src="c1.xhtml"/></navPoint></navMap></ncx>')
        for k, (head, text) in enumerate(chapters):
            z.writestr(f"OPS/c{k}.xhtml", f"<html><head><style>x</style></head><body><h1>{head}</h1><p>{text}</p></body></html>")
        z.writestr("OPS/a.png", png(50, 50))
        z.writestr("OPS/b.png", png(49, 50))
        z.writestr("OPS/bad.png", b"none")
    return out.getvalue()


SEA = "the sea and the whale and the long voyage of the ship " * 12
WAR = "a war of kings and swords and the fall of the old castle " * 12


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "B.epub").write_bytes(book("Sea", [("Start", SEA), ("Tiny", "short"), ("End", SEA)], '<dc:identifier opf:scheme="ISBN">0-306-40615-x</dc:identifier><dc:identifier>isbn:9780306406157</dc:identifier>'))
    (tmp_path / "sub" / "a.EPUB").write_bytes(book("War", [("Only", WAR)]))
    (tmp_path / "c.epub").write_bytes(b"broken")
    (tmp_path / "note.txt").write_text("x")
    return tmp_path


def test_discovery_is_sorted_by_name_and_ignores_case(spark, folder):
    assert [r["file_name"] for r in files.discover(spark, str(folder)).collect()] == ["a.EPUB", "B.epub", "c.epub"]
    assert [r["file_name"] for r in files.discover(spark, str(folder), recursive=False).collect()] == ["B.epub", "c.epub"]
    assert files.can_extract("x/Y.EPUB", "epub") and not files.can_extract("x.epub", "pdf")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.discover(spark, str(folder / "none")).collect()


def test_epub(spark, folder):
    found = files.identified(files.discover(spark, str(folder), content=True))
    books = epub.read(found).join(found.select("path", "book_id"), "path")
    assert {r["path"].rpartition("/")[2]: r["status"] for r in books.collect()} == {"a.EPUB": "completed", "B.epub": "completed", "c.epub": "failed"}
    done = books.filter("status = 'completed'")
    chapters = epub.chapters(done.filter("title = 'Sea'")).orderBy("number").collect()
    assert [(r["number"], r["title"]) for r in chapters] == [(1, "Start"), (2, "End")]  # the short one goes, numbers close up
    meta = epub.metadata(done.filter("title = 'Sea'")).first()
    assert (meta["isbn"], meta["isbn13"], meta["authors"], meta["description"]) == ("030640615X", "9780306406157", ["Ann", "Bob"], "All of it")
    assert [r["filename"] for r in epub.images(done.filter("title = 'Sea'")).collect()] == ["a.png"]
    toc = done.filter("title = 'Sea'").first()["toc"]
    assert [(e["level"], e["title"], e["parent_seq"]) for e in toc] == [(0, "One", None), (1, "Deep", 0), (0, "Two", None)]


def test_library_round(spark, folder, tmp_path, capsys):
    config = Config()
    config.storage.path, config.chunking.min_tokens, config.chunking.max_tokens, config.embedding.dimension = str(tmp_path / "lib"), 20, 80, 64
    library = Library(spark, config)
    report = library.ingest_directory(str(folder))
    assert report.stored == 2 and [p.rpartition("/")[2] for p in report.errors] == ["c.epub"]
    stats = library.statistics().first()
    assert stats["total_books"] == 2 and stats["points_count"] == stats["vectors_count"] == stats["total_chunks"] + 2
    assert {r["title"] for r in library.list_books().collect()} == {r["title"] for r in library.search("voyage", books=True).collect()}
    best = library.search("whale voyage ship", 3).collect()
    assert len(best) == 3 and "whale" in best[0]["content"]
    assert library.ingest_directory(str(folder)).stored == 0  # all done, failed ones too
    before = sorted(map(str, library.collection.read().drop("embedding").collect()))
    assert library.ingest_book(str(folder / "B.epub")).stored == 1
    assert sorted(map(str, library.collection.read().drop("embedding").collect())) == before  # replaced, not repeated
    exact = library.search("whale voyage ship", 5).collect()
    assert library.search("whale voyage ship", 5, approximate=True).collect() == exact  # no index yet
    library.build_index()
    library.build_index()
    index = library.vectors()
    assert index.exists() and index.points().count() == library.collection.read().count()
    near = library.search("whale voyage ship", 5, approximate=True).collect()
    assert near[0] == exact[0] and len(near) <= 5 and library.search("voyage", books=True, approximate=True).count() <= 2
    book_id = library.list_books().first()["book_id"]
    first = library.chapter(book_id, limit=1).first()["chapter_number"]
    assert library.lookup(book_id).count() == 1 and library.chapter(book_id, chapter=first).count() >= 1 and library.chapter(book_id, chapter=999).count() == 0
    said = library.analyses().count()
    assert library.delete_book(book_id) > 1 and library.delete_book(book_id) == 0
    assert library.statistics().first()["total_books"] == 1 and not library.vectors().exists()
    assert library.analyses().count() == said - 1 and library.contents(book_id).count() == 0
    path = tmp_path / "config.yaml"
    config.to_yaml(path)
    assert cli.main(["--config", str(path), "search", "castle", "--json", "-n", "1"], spark) == 0
    assert '"score"' in capsys.readouterr().out
    assert cli.main(["--config", str(path), "stats"], spark) == 0
    assert cli.main(["--config", str(path), "list-books"], spark) == 0
    assert cli.main(["--config", str(path), "delete", "none", "--yes"], spark) == 0
    assert cli.main(["--config", str(path), "ingest", str(folder / "c.epub")], spark) == 1


def test_config(tmp_path, monkeypatch):
    path = tmp_path / "c.yaml"
    assert cli.main(["init-config", str(path)]) == 0
    assert Config.from_yaml(path) == Config()
    path.write_text("chunking: {min_tokens: 7}")
    monkeypatch.setenv("QUIREFLOW_CONFIG", str(path))
    assert Config.load().chunking.min_tokens == 7
    path.write_text("")
    assert Config.load() == Config()
    path.write_text("chunking: {none: 7}")
    with pytest.raises(ValueError, match="unknown keys"):
        Config.load()
    with pytest.raises(FileNotFoundError):
        Config.load(tmp_path / "none.yaml")


class Talker:
    """Answers that name the agent; the summary of a chapter with swords in it fails."""

    def analyze(self, agent: str, text: str) -> str:
        if agent == "chapter_summary" and "swords" in text:
            raise ValueError("no summary")
        forms = {"technical_concepts": '{"concepts": [{"term": "whale"}]}', "key_quotes": '{"quotes": [{"text": "call me"}]}', "chapter_summary": '{"summary": "short"}', "describe": "a ship", "ocr": "NO_TEXT", "classify": "Photo"}
        return forms.get(agent, "{}")


def test_ingest_runs_the_whole_committee(spark, folder, tmp_path):
    config = Config()
    config.storage.path, config.llm.attempts, config.vlm.enabled = str(tmp_path / "store"), 1, True
    library = Library(spark, config, analyzer=Talker())
    report = library.ingest_directory(str(folder))
    assert report.stored == 1 and {p.rpartition("/")[2] for p in report.errors} == {"a.EPUB", "c.epub"}
    (row,) = library.analyses().collect()
    assert [(e["level"], e["title"]) for e in library.contents(row["book_id"]).collect()] == [(0, "One"), (1, "Deep"), (0, "Two")]
    assert [c["term"] for c in row["technical_concepts"]] == ["whale"]
    assert [(q["text"], q["chapter"]) for q in row["key_quotes"]] == [("call me", "Start"), ("call me", "End")]
    assert [(s["title"], s["summary"]) for s in row["chapter_summaries"]] == [("Start", "short"), ("End", "short")]
    assert [(i["filename"], i["description"], i["image_type"]) for i in row["image_descriptions"]] == [("a.png", "a ship", "photo")]


def test_a_book_without_chapters_is_read_as_a_whole(spark):
    books = spark.createDataFrame([("b", "bare text")], "book_id string, raw_text string")
    none = spark.createDataFrame([], "book_id string, number int, title string, content string")
    found = {(r["agent"], r["input"]) for r in A.chapter_windows(none, books=books).collect()}
    assert found == {("technical_concepts", "bare text"), ("key_quotes", "bare text")}


def test_what_agents_read(spark):
    books = spark.createDataFrame([("a", "Sea", "all text", 12, ["Ann"], "1999-01-01"), ("b", None, "bare text", 2, None, None)], "book_id string, title string, raw_text string, word_count long, authors array<string>, date string")
    chapters = spark.createDataFrame([("a", k, f"C{k}", ("x" * 6000 if k == 1 else f"text {k}"), 10 * k) for k in range(1, 24)], "book_id string, number int, title string, content string, word_count long")
    toc = spark.createDataFrame([("a", k, k % 2, f"T{k}" if k else None) for k in range(40)], "book_id string, seq int, level int, title string")
    found = {(r["book_id"], r["agent"]): r["input"] for r in A.windows(books, chapters, toc=toc, tags=("One", "Two")).collect()}
    assert len(found) == 8
    line = lambda k: f"{'  ' * (k % 2)}- {f'T{k}' if k else 'Unknown'}"
    flat = lambda n: "\n".join(line(k).strip() for k in range(n))
    heads = lambda n, limit: "\n\n---\n\n".join(f"## C{k}\n\n" + ("x" * min(limit, 6000) + "..." * (limit < 6000) if k == 1 else f"text {k}") for k in range(1, n + 1))
    assert found["a", "bibliography"] == f"Metadata:\ntitle: Sea\nauthors: Ann\ndate: 1999-01-01\n\nSample:\n{heads(2, 5000)}"
    assert found["a", "genre_tags"] == f"Title:\nSea\n\nTags:\nOne, Two\n\nContents:\n{flat(20)}\n\nSample:\n{heads(3, 8000)}"
    assert found["a", "themes"] == f"Title:\nSea\n\nContents:\n{flat(25)}\n\nSample:\n{heads(5, 8000)}"
    listed = "\n".join(f"- C{k} ({10 * k} words)" for k in range(1, 21))
    assert found["a", "overview"] == "Title:\nSea\n\nWords:\n12\n\nContents:\n" + "\n".join(line(k) for k in range(30)) + f"\n\nChapters:\n{listed}\n\nSample:\n{heads(5, 8000)}"
    assert found["b", "overview"] == "Title:\nUnknown\n\nWords:\n2\n\nContents:\nNot available\n\nChapters:\nNot available\n\nSample:\nbare text"
    assert found["b", "bibliography"] == "Metadata:\nNo metadata available\n\nSample:\nbare text"
    with pytest.raises(ValueError, match="unknown agents"):
        A.windows(books, chapters, ("poet",))


def test_settings_do_something(spark, folder, tmp_path):
    config = Config()
    config.storage.path, config.llm.attempts, config.chunking.strategy, config.chunking.min_tokens, config.chunking.max_tokens = str(tmp_path / "s"), 1, "fixed", 5, 15
    config.agents.enabled = {"chapter_summary": False, "key_quotes": False, "themes": False}
    library = Library(spark, config, analyzer=Talker())
    assert library.ingest_directory(str(folder)).stored == 2  # the summary that fails a book isn't asked for
    rows = library.analyses().collect()
    assert all(r["chapter_summaries"] == [] and r["key_quotes"] == [] and [c["term"] for c in r["technical_concepts"]] == ["whale"] for r in rows)
    lengths = [len(r["content"]) for r in library.collection.read().filter("NOT is_metadata").select("content").collect()]
    assert max(lengths) <= 40 and len(lengths) > 20
    config.chunking.strategy = "none"
    with pytest.raises(ValueError, match="unknown strategy"):
        library.ingest_book(str(folder / "B.epub"))
    config.agents.enabled = {"poet": True}
    with pytest.raises(ValueError, match="unknown agents"):
        library.enabled(A.BOOK_AGENTS)


def test_images_come_into_the_chunks_of_their_pages(spark, tmp_path):
    config = Config()
    config.storage.path, config.vlm.enabled, config.chunking.min_tokens, config.chunking.max_tokens = str(tmp_path / "s"), True, 1, 50
    library = Library(spark, config)
    books = spark.createDataFrame([("b", "Book", ["Ann"], "one\n\ntwo")], "book_id string, title string, authors array<string>, raw_text string")
    chapters = spark.createDataFrame([("b", 1, "C1", 1, 3, "one"), ("b", 2, "C2", 4, 5, "two")], "book_id string, number int, title string, start_page int, end_page int, content string")
    described = spark.createDataFrame([("b", 0, "chart", "bars", "", 2), ("b", 1, "photo", "cat", "", None)], "book_id string, ord int, image_type string, description string, ocr_text string, page_number int")
    analysis = A.assembled(books, spark.createDataFrame([], f"book_id string, {A.ANSWERS}, json variant"))
    stored = library.points(books, chapters, analysis, books, described).filter("NOT is_metadata").orderBy("chapter_number").collect()
    assert [r["content"] for r in stored] == ["one\n\n[Image Context]\n[CHART] bars", "two"]


def test_chat_model(tmp_path):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Model(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, self.headers["Authorization"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            body = json.dumps({"choices": [{"message": {"content": '{"genres": ["sea"]}'}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    address = f"http://127.0.0.1:{server.server_port}/v1"
    chat = A.Committee(A.ChatAnalyzer(address, "m", 7, 0.5, 5, {"genre_tags": "be brief"}, "k"), A.ChatAnalyzer(address + "/", "eyes"))
    assert chat.analyze("genre_tags", "a book") == '{"genres": ["sea"]}'
    chat.analyze("describe", "data:image/png;base64,AA==")
    server.shutdown()
    (path, key, body), (_, _, image) = seen
    assert (path, key) == ("/v1/chat/completions", "Bearer k")
    assert body == {"model": "m", "messages": [{"role": "system", "content": "be brief"}, {"role": "user", "content": "a book"}], "max_tokens": 7, "temperature": 0.5}
    assert image["model"] == "eyes" and image["messages"][1]["content"] == [{"type": "image_url", "image_url": {"url": "data:image/png;base64,AA=="}}]
