"""The collection: chunk points and book points in one table, replaced by book."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import POINTS
from .commits import CommitLog, Conflict, drop_all_but


def book_card(analysis: DataFrame) -> DataFrame:
    """Adds `card`, the five lines of a book that are embedded for search over books."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit("")))
    listed = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), ", ")
    return analysis.withColumn("card", F.concat_ws("\n", line("Title", F.col("title")), line("Authors", listed("authors")), line("Summary", F.col("summary")), line("Topics", listed("main_topics")), line("Tags", listed("tags"))))


def points(chunks: DataFrame, books: DataFrame) -> DataFrame:
    """Embedded chunks with their book's payload, and one point for each book; books has title, payload and embedding."""
    payload = [c for c in ("title", "authors", "genres", "tags", "difficulty_level") if c in books.columns]
    own = chunks.join(books.select("book_id", *payload), "book_id", "left").withColumn("is_metadata", F.lit(False))
    return own.unionByName(books.withColumn("is_metadata", F.lit(True)), allowMissingColumns=True)


def replaced(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The collection after an upsert: all points of a book that comes again are replaced, so ingesting twice changes nothing."""
    return stored.join(fresh.select("book_id").distinct(), "book_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def without_books(stored: DataFrame, book_ids: list) -> DataFrame:
    return stored.filter(~F.coalesce(F.col("book_id").isin(*book_ids), F.lit(False)))


def info(stored: DataFrame, vector: str = "embedding") -> DataFrame:
    """Points, points with a vector, books and chunks of a collection, and its status."""
    return stored.agg(F.count(F.lit(1)).alias("points_count"), F.count(vector).alias("vectors_count"), F.count_if("is_metadata").alias("total_books"), F.count_if(~F.col("is_metadata")).alias("total_chunks"), F.lit("green").alias("status"))


def book_list(stored: DataFrame, limit: int = 1000) -> DataFrame:
    return stored.filter("is_metadata").select("book_id", "title", "authors", "genres", "tags", "difficulty_level").orderBy("title", "book_id").limit(limit)


def scroll(stored: DataFrame, book_id, limit: int = 100, offset: int = 0, chapter: int | None = None) -> DataFrame:
    """A book's chunks in order, or those of one of its chapters, some at a time."""
    own = F.lit(True) if chapter is None else F.col("chapter_number") == chapter
    return stored.filter((F.col("book_id") == book_id) & ~F.col("is_metadata") & own).orderBy("chunk_index").offset(offset).limit(limit)


def lookup(stored: DataFrame, book_id) -> DataFrame:
    """The point of one book, or no row."""
    return stored.filter((F.col("book_id") == book_id) & F.col("is_metadata"))


#: Bits of a file's Bloom filter of tags, as words of 64, and how many each tag sets.
BLOOM_WORDS, BLOOM_HASHES = 16, 3
TOUCHED, FILES = "book_id string", "file string, points bigint, low string, high string, " + ", ".join(f"w{k} bigint" for k in range(BLOOM_WORDS))


def _bits(value: Column) -> list[tuple[Column, Column]]:
    """(word, bit in it) of a value for each hash."""
    at = [F.pmod(F.xxhash64(value, F.lit(k)), F.lit(64 * BLOOM_WORDS)) for k in range(BLOOM_HASHES)]
    return [(F.floor(x / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (x % 64).cast("int"))) for x in at]


def _may_hold(value: str) -> Column:
    """Whether a file's Bloom filter may hold a value."""
    found = F.lit(True)
    for word, bit in _bits(F.lit(value)):
        held = F.element_at(F.array(*[f"w{k}" for k in range(BLOOM_WORDS)]), word + 1)
        found = found & (held.bitwiseAND(bit) != 0)
    return found


class Collection:
    """A collection of points under a path, merged when it is read.

    A write adds a delta: a folder of new points, the books that it touches, and what its files hold (bounds of book_id, and a
    Bloom filter of tags). It changes nothing that is there, so it costs what its books cost. A point counts if no later delta
    touched its book. The newest file of `log` lists the deltas that make the collection; a commit writes the next one under a
    number that must be free, and a writer that lost the race takes the number after it. Compaction folds deltas into one.
    """

    #: Deltas that are folded into one when there are more.
    COMPACT = 32

    def __init__(self, spark: SparkSession, path: str, schema: str = POINTS):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.log = CommitLog(spark, f"{self.path}/log")

    def versions(self) -> list[int]:
        return self.log.versions()

    def version(self) -> int:
        return self.log.version()

    def deltas(self, version: int | None = None) -> dict[str, int]:
        """The deltas of a version by name, each with the version that brought it: COMPACT of them, or a few more."""
        return self.log.state(version)

    def _commit(self, name: str, folds: set[str] = frozenset()) -> int:
        """Make a delta count, instead of those that it folds; the version it came with."""

        def change(number: int, held: dict) -> dict:
            if not folds <= held.keys():
                raise Conflict("another compaction was first")
            # what is folded is as old as its newest part; a delta that came meanwhile stays newer
            own = max((held[f] for f in folds), default=number)
            return {k: v for k, v in held.items() if k not in folds} | {name: own}

        return self.log.commit(change)

    def _write(self, name: str, rows: DataFrame) -> None:
        """A delta's points, sorted so that a file holds a run of books, and what its files hold."""
        schema = self.spark.createDataFrame([], self.schema).schema
        columns = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
        order = ["book_id", "is_metadata", "chunk_index"]
        here = f"{self.path}/data/{name}"
        rows.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(here)
        stored = self.spark.read.schema(schema).parquet(here).select("book_id", "tags" if "tags" in schema.names else F.lit(None).cast("array<string>").alias("tags"), F.col("_metadata.file_name").alias("file"))
        tagged = stored.select("file", "book_id", F.posexplode_outer("tags").alias("n", "tag")).withColumn("first", F.coalesce(F.col("n"), F.lit(0)) == 0)
        bits = [F.bit_or(F.coalesce(reduce(lambda x, y: x.bitwiseOR(y), [F.when(F.col("tag").isNotNull() & (word == k), bit).otherwise(F.lit(0).cast("long")) for word, bit in _bits(F.col("tag"))]), F.lit(0).cast("long"))).alias(f"w{k}") for k in range(BLOOM_WORDS)]
        tagged.groupBy("file").agg(F.count_if("first").alias("points"), F.min("book_id").alias("low"), F.max("book_id").alias("high"), *bits).coalesce(1).write.parquet(f"{self.path}/files/{name}")

    def _touch(self, name: str, books: DataFrame) -> None:
        books.select(F.col("book_id").cast("string").alias("book_id")).distinct().write.parquet(f"{self.path}/touched/{name}")

    def files(self, books: list[str] | None = None, tags: list[str] | None = None, held: dict[str, int] | None = None) -> DataFrame:
        """(file, points, low, high, delta) of the files that may hold points of any of the books, with any of the tags."""
        names = list(self.deltas() if held is None else held)
        if not names:
            return self.spark.createDataFrame([], f"{FILES}, delta string").select("file", "points", "low", "high", "delta")
        rows = self.spark.read.schema(FILES).parquet(*[f"{self.path}/files/{n}" for n in names]).withColumn("delta", F.element_at(F.split("_metadata.file_path", "/"), -2))
        if books is not None:
            rows = rows.filter(reduce(lambda x, y: x | y, [(F.col("low") <= b) & (F.col("high") >= b) for b in books], F.lit(False)))
        if tags is not None:
            rows = rows.filter(reduce(lambda x, y: x | y, [_may_hold(t) for t in tags], F.lit(False)))
        return rows.select("file", "points", "low", "high", "delta")

    def read(self, books: list[str] | None = None, tags: list[str] | None = None, held: dict[str, int] | None = None) -> DataFrame:
        """All points, or those of some books, or with any of some tags: other files aren't opened.

        held are the deltas of a version, by default the newest. The list of files is the driver's, as it is in every scan.
        """
        held = self.deltas() if held is None else held
        schema = self.spark.createDataFrame([], self.schema).schema
        if books is None and tags is None:
            places = [f"{self.path}/data/{n}" for n in held]
        else:
            places = [f"{self.path}/data/{r['delta']}/{r['file']}" for r in self.files(books, tags, held).select("delta", "file").collect()]
        if not places:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*places)
        if books is not None:
            rows = rows.filter(F.col("book_id").isin(*books))
        if tags is not None:
            rows = rows.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
        if len(held) == 1:
            return rows
        age = F.create_map(*[x for n, v in held.items() for x in (F.lit(n), F.lit(v))])  # COMPACT entries, or a few more
        name = lambda back: F.element_at(F.split(F.col("_metadata.file_path"), "/"), back)
        last = self.touched(held, age).groupBy("book_id").agg(F.max("_version").alias("_last"))
        if books is not None:
            last = last.filter(F.col("book_id").isin(*books))
        aged = rows.withColumn("_version", F.element_at(age, name(-2)))
        return aged.join(last, "book_id", "left").filter(F.col("_last").isNull() | (F.col("_version") >= F.col("_last"))).select(*schema.names)

    def touched(self, held: dict[str, int], age: Column) -> DataFrame:
        """(book_id, _version): the books that each delta replaced or removed."""
        rows = self.spark.read.schema(TOUCHED).parquet(*[f"{self.path}/touched/{n}" for n in held])
        return rows.withColumn("_version", F.element_at(age, F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)))

    def upsert(self, fresh: DataFrame) -> int:
        """Add points; those of books that come again are replaced. Returns the version."""
        name = uuid.uuid4().hex
        self._write(name, fresh)
        self._touch(name, self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{name}"))
        version = self._commit(name)
        if len(self.deltas(version)) > self.COMPACT:
            self.compact()
        return version

    def delete(self, book_id: str) -> int:
        """Remove a book's points and return how many there were."""
        gone = self.read([book_id]).count()
        if gone:
            name = uuid.uuid4().hex
            book = self.spark.createDataFrame([(book_id,)], TOUCHED)
            self._write(name, self.spark.createDataFrame([], self.schema))
            self._touch(name, book)
            self._commit(name)
        return gone

    def compact(self) -> bool:
        """Fold all deltas into one; False if another compaction was first. Writes meanwhile are kept."""
        held = self.deltas()
        if len(held) < 2:
            return False
        name = uuid.uuid4().hex
        self._write(name, self.read(held=held))
        self._touch(name, self.spark.createDataFrame([], TOUCHED))
        try:
            self._commit(name, set(held))
        except Conflict:
            return False
        return True

    def vacuum(self, keep: int = 2) -> None:
        """Remove old versions but for the newest ones, and the deltas that only they had. Not while a write is under way."""
        found = self.versions()
        kept = {n for v in found[-keep:] for n in self.deltas(v)}
        for kind in ("data", "touched", "files"):
            drop_all_but(self.spark, f"{self.path}/{kind}", kept)
        self.log.drop(found[:-keep])


def content_preview(stored: DataFrame, n: int = 200) -> DataFrame:
    return stored.withColumn("preview", T.clip(F.col("content"), n))
