"""The library as one object: ingest files, search, list, delete, count."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import logs
from .config import Config
from .functions import text as T
from .operators import analysis as A
from .operators import chapters as C
from .operators import chunking as K
from .operators import embedding as E
from .operators import retrieval as R
from .operators import store as S
from .operators.ann import VectorIndex
from .operators.batch import remaining
from .schema import PROGRESS
from .sources import epub, files, pdf

CHAPTER = ("book_id", "number", "title", "start_page", "end_page", "content")


@dataclass
class Report:
    """What a run did: books stored, and errors by path."""

    stored: int
    errors: dict[str, str]


class Library:
    """Books of a folder of files, in a collection under config.storage.path."""

    def __init__(self, spark: SparkSession, config: Config | None = None, embedder: E.Embedder | None = None, analyzer: A.Analyzer | None = None):
        self.spark, self.config = spark, config or Config()
        self.embedder = embedder or E.HashingEmbedder(self.config.embedding.dimension)
        self.analyzer = analyzer or self.models()
        self.collection = S.Collection(spark, f"{self.config.storage.path}/points")
        self.progress_path = f"{self.config.storage.path}/progress"
        self.removed_path = f"{self.config.storage.path}/removed"
        self.analyses_path, self.contents_path = f"{self.config.storage.path}/analyses", f"{self.config.storage.path}/contents"

    def models(self) -> A.Analyzer:
        """The analyzer of the settings: chat models where they have an address, else the one that needs no model."""
        ask = lambda m: A.ChatAnalyzer(m.base_url, m.model, m.max_tokens, m.temperature, m.timeout) if m.base_url else A.WordAnalyzer()
        return A.Committee(ask(self.config.llm), ask(self.config.vlm))

    def enabled(self, agents: tuple[str, ...]) -> tuple[str, ...]:
        """Those of the agents that the settings leave on; an unknown name there is an error."""
        on = self.config.agents.enabled
        if unknown := set(on) - {*A.BOOK_AGENTS, *A.CHAPTER_AGENTS}:
            raise ValueError(f"unknown agents {sorted(unknown)}")
        return tuple(a for a in agents if on.get(a, True))

    def progress(self) -> DataFrame:
        try:
            return self.spark.read.schema(PROGRESS).parquet(self.progress_path)
        except Exception as e:  # the first run has none
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], PROGRESS)

    def read(self, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """EPUB and PDF files (path, content, book_id, document_type) as their readers give them, each file opened once."""
        keys = found.select("path", "book_id")
        return tuple(self.answers(reader.read(found.filter(F.col("document_type") == kind)).join(keys, "path")) for kind, reader in (("epub", epub), ("pdf", pdf)))

    def parsed(self, by_epub: DataFrame, by_pdf: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """(books, chapters, contents, failures) of what read() gives."""
        failed = by_epub.filter("status = 'failed'").select("path", "error").unionByName(by_pdf.filter("status = 'failed'").select("path", "error"))
        epubs, pdfs = by_epub.filter("status = 'completed'"), by_pdf.filter("status = 'completed'")
        pages = pdfs.select("book_id", F.explode("pages").alias("p")).select("book_id", "p.page", "p.text")
        toc = pdfs.select("book_id", F.explode("toc").alias("t")).select("book_id", "t.*")
        chapters = epub.chapters(epubs).select(*CHAPTER).unionByName(pdf.chapters(pages, toc).select(*CHAPTER))
        meta = epub.metadata(epubs).unionByName(pdf.metadata(pdfs), allowMissingColumns=True)
        raw = chapters.groupBy("book_id").agg(T.ordered_concat(F.col("number"), F.col("content"), "\n\n").alias("raw_text"))
        books = meta.join(raw, "book_id", "left").withColumn("raw_text", F.coalesce("raw_text", F.lit("")))
        entries = epub.contents(epubs).select("book_id", "seq", "level", "title").unionByName(pdf.contents(pdfs).select("book_id", "seq", "level", "title"))
        return books.withColumn("word_count", T.word_count(F.col("raw_text"))), chapters, entries, failed

    def answers(self, calls: DataFrame) -> DataFrame:
        """Answers from a table of their own: a model is asked once, however often its answer is read."""
        path = f"{self.config.storage.path}/answers/{uuid.uuid4().hex}"
        calls.write.parquet(path)
        return self.spark.read.schema(calls.schema).parquet(path)

    def images(self, by_epub: DataFrame, by_pdf: DataFrame) -> DataFrame:
        """Images of parsed files, as found by the readers; none unless the settings have a vision model enabled."""
        fields = ("book_id", "ord", "filename", "content_type", "width", "height", "page_number", "base64_data")
        done = lambda df: df.filter("status = 'completed'")
        each = epub.images(done(by_epub)).select(*fields).unionByName(pdf.images(done(by_pdf)).select(*fields))
        return each if self.config.vlm.enabled else each.limit(0)

    def asked(self, calls: DataFrame) -> DataFrame:
        return self.answers(A.answered(calls, self.analyzer, attempts=self.config.llm.attempts))

    def analysed(self, books: DataFrame, chapters: DataFrame, toc: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """(analysis rows, bibliographies, image descriptions, failures): image calls, the agents of books, then those of chapters."""
        described = self.answers(A.image_descriptions(images, self.asked(A.image_calls(images))))
        tags = tuple(self.config.agents.predefined_tags) or A.DEFAULT_TAGS
        of_books, of_chapters = self.enabled(A.BOOK_AGENTS), self.enabled(A.CHAPTER_AGENTS)
        none = self.spark.createDataFrame([], f"book_id string, number int, title string, {A.ANSWERS}")
        rows = A.normalised(self.asked(A.windows(books, chapters, of_books, toc, tags)) if of_books else none)
        by_chapter = A.normalised(self.asked(A.chapter_windows(chapters, of_chapters, books)) if of_chapters else none)
        said = books.select("book_id").join(A.form(rows, "bibliography"), "book_id", "left")
        return A.assembled(books, rows, by_chapter, described), A.merged_bibliography(said, books), described, A.broken_books(by_chapter)

    def since_removal(self, rows: DataFrame) -> DataFrame:
        """Rows (book_id, at) that are newer than the book's removal."""
        try:
            removed = self.spark.read.schema("book_id string, at timestamp").parquet(self.removed_path)
        except Exception as e:  # nothing was removed yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return rows
        last = removed.groupBy("book_id").agg(F.max("at").alias("removed_at"))
        return rows.join(last, "book_id", "left").filter(F.col("removed_at").isNull() | (F.col("at") > F.col("removed_at"))).drop("removed_at")

    def analyses(self) -> DataFrame:
        """The last analysis of each book: what all agents said."""
        stored = self.since_removal(self.spark.read.parquet(self.analyses_path))
        fields = [c for c in stored.columns if c not in ("book_id", "at")]
        return stored.groupBy("book_id").agg(F.max_by(F.struct(*fields), "at").alias("x")).select("book_id", "x.*")

    def contents(self, book_id: str) -> DataFrame:
        """(seq, level, title) of a book's contents as they were last read."""
        own = self.since_removal(self.spark.read.parquet(self.contents_path).filter(F.col("book_id") == book_id))
        last = own.agg(F.max("at").alias("last"))  # one row: entries of an earlier reading don't count, whatever their number
        return own.join(F.broadcast(last), F.col("at") == F.col("last")).select("seq", "level", "title").orderBy("seq")

    def points(self, books: DataFrame, chapters: DataFrame, analysis: DataFrame, found: DataFrame, described: DataFrame) -> DataFrame:
        """Chunk and book points of parsed and analysed books, embedded; chunks have what is seen on the images of their pages."""
        how = self.config.chunking
        payload = found.select("book_id", "title", "authors").join(A.payload(analysis), "book_id")
        chunks = K.chunk_books(books, chapters, how.preserve_structure, how.strategy, min_tokens=how.min_tokens, max_tokens=how.max_tokens, overlap=how.overlap, compat=how.compat)
        if self.config.vlm.enabled:
            chunks = C.with_images(chunks, described, ["book_id"], "chapter_number").drop("images", "n_images")
        own = E.embed_chunks(chunks.drop("position", "n_raw"), self.embedder, batch_size=self.config.embedding.batch_size)
        cards = S.book_card(payload).withColumn("embedding", E.embed(F.col("card"), self.embedder)).drop("card")
        return S.points(own, cards)

    def ingest_files(self, found: DataFrame, batch_id: int = 0) -> Report:
        """Parse, analyse, chunk, embed and store files (path, content); both kinds of points are one write."""
        rows = files.identified(files.dispatched(found)).filter("document_type IS NOT NULL").persist()
        try:
            with logs.timed("ingest"):
                read = self.read(rows)
                books, chapters, toc, failed = self.parsed(*read)
                stored = books.count()
                if stored:
                    analysis, found, described, broken = self.analysed(books, chapters, toc, self.images(*read))
                    failed = failed.unionByName(broken.join(rows.select("path", "book_id"), "book_id").select("path", "error"))
                    whole = lambda df: df.join(broken, "book_id", "left_anti")
                    stored = whole(books).count()
                    whole(toc).withColumn("at", F.current_timestamp()).write.mode("append").parquet(self.contents_path)
                    whole(analysis).withColumn("at", F.current_timestamp()).write.mode("append").parquet(self.analyses_path)
                    self.collection.upsert(self.points(whole(books), whole(chapters), whole(analysis), whole(found), described))
                done = rows.select("path").join(failed, "path", "left").select("path", F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status"), "error", F.current_timestamp().cast("timestamp_ntz").alias("at"))
                done.write.mode("append").parquet(self.progress_path)
                errors = {r["path"]: r["error"] for r in failed.collect()}  # one short row for each broken file of the batch
                return Report(stored, errors)
        finally:
            rows.unpersist()

    def ingest_directory(self, folder: str) -> Report:
        """All files of a folder that weren't done before."""
        how = self.config.batch
        listed = files.discover(self.spark, folder, how.recursive)
        left = remaining(listed, self.progress(), how.max_files, how.retry_failed)
        found = files.discover(self.spark, folder, how.recursive, content=True).join(left.select("path"), "path", "left_semi")
        return self.ingest_files(found)

    def ingest_book(self, path: str) -> Report:
        found = self.spark.read.format("binaryFile").load(path).select("path", "content")
        return self.ingest_files(found)

    def search(self, query: str, k: int = 10, filters: dict | None = None, books: bool = False, approximate: bool = False) -> DataFrame:
        """The k best points that match the filters, ties by book and chunk; files without the wanted books or tags aren't opened.

        An approximate search reads the cells of the vector index that are nearest to the query, if there is an index.
        """
        if approximate and (index := self.vectors()).exists():
            return R.results(index.search(E.embed_query(query, self.embedder), k, (filters or {}) | ({"is_metadata": True} if books else {})))
        listed = lambda name: None if not filters or filters.get(name) is None else filters[name] if isinstance(filters[name], list) else [filters[name]]
        stored = self.collection.read(listed("book_id"), listed("tags"))
        own = R.books_only(stored) if books else stored
        return R.results(R.top_k(own, E.embed_query(query, self.embedder), k, filters, ("book_id", "chunk_index")))

    def list_books(self, limit: int = 1000) -> DataFrame:
        return S.book_list(self.collection.read(), limit)

    def chapter(self, book_id: str, offset: int = 0, limit: int = 100, chapter: int | None = None) -> DataFrame:
        """A book's chunks in order, or those of one chapter; only the book's files are opened."""
        return S.scroll(self.collection.read([book_id]), book_id, limit, offset, chapter)

    def lookup(self, book_id: str) -> DataFrame:
        return S.lookup(self.collection.read([book_id]), book_id)

    def delete_book(self, book_id: str) -> int:
        """Remove a book's points, and what was read and said of it; how many points there were."""
        gone = self.collection.delete(book_id)
        if gone:
            self.spark.createDataFrame([(book_id,)], "book_id string").withColumn("at", F.current_timestamp()).write.mode("append").parquet(self.removed_path)
        return gone

    def vectors(self) -> VectorIndex:
        """The vector index of the collection as it is; it may not be built."""
        return VectorIndex(self.spark, f"{self.config.storage.path}/vectors/{self.collection.version():020d}", ("book_id", "chunk_index"))

    def build_index(self) -> None:
        """Index the vectors of the collection as it is. A later write makes search exact again, until the next build."""
        if not self.vectors().exists():
            self.vectors().build(self.collection.read())

    def statistics(self) -> DataFrame:
        return S.info(self.collection.read())
