"""Commands: ingest, search, list-books, delete, stats, init-config."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import logs
from .config import Config
from .functions import text as T
from .library import Library
from .operators.batch import exit_code


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quireflow", description=__doc__)
    top.add_argument("--config")
    top.add_argument("--log-level", default="INFO")
    verbs = top.add_subparsers(dest="verb", required=True)
    ingest = verbs.add_parser("ingest", help="a file, or a folder with what wasn't done before")
    ingest.add_argument("path")
    ingest.add_argument("--flat", action="store_true", help="without subfolders")
    ingest.add_argument("--max-files", type=int, default=0)
    ingest.add_argument("--retry-failed", action="store_true")
    search = verbs.add_parser("search")
    search.add_argument("query")
    search.add_argument("-n", type=int, default=10)
    search.add_argument("--tag", action="append", default=[])
    search.add_argument("--genre", action="append", default=[])
    search.add_argument("--books", action="store_true")
    search.add_argument("--json", action="store_true")
    listed = verbs.add_parser("list-books")
    listed.add_argument("--json", action="store_true")
    delete = verbs.add_parser("delete")
    delete.add_argument("book_id")
    delete.add_argument("--yes", action="store_true", help="without asking")
    verbs.add_parser("stats")
    init = verbs.add_parser("init-config")
    init.add_argument("path")
    return top


def show(found: DataFrame, as_json: bool) -> None:
    if as_json:
        for line in found.toJSON().toLocalIterator():
            print(line)
    else:
        found.show(1000, truncate=False)


def filters(tags: list[str], genres: list[str]) -> dict:
    """Any of the tags, and any of the genres."""
    return {k: v for k, v in (("tags", tags), ("genres", genres)) if v}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = arguments().parse_args(args)
    if given.verb == "init-config":
        Config().to_yaml(given.path)
        return 0
    config = Config.load(given.config)
    logs.setup(given.log_level, config.logging.file)
    library = Library(spark or SparkSession.builder.appName("quireflow").getOrCreate(), config)
    if given.verb == "ingest":
        config.batch.recursive, config.batch.max_files, config.batch.retry_failed = not given.flat, given.max_files, given.retry_failed
        single = given.path.lower().endswith((".epub", ".pdf"))
        try:
            report = library.ingest_book(given.path) if single else library.ingest_directory(given.path)
        except KeyboardInterrupt:
            return exit_code(0, interrupted=True)
        print(f"{report.stored} stored, {len(report.errors)} failed")
        for path, error in sorted(report.errors.items()):
            print(f"{path}: {error}")
        return exit_code(len(report.errors))
    if given.verb == "search":
        found = library.search(given.query, given.n, filters(given.tag, given.genre), given.books)
        clipped = T.clip(F.col("content"), 200 if given.json else 100)
        show(found.withColumn("content", clipped), given.json)
    elif given.verb == "list-books":
        found = library.list_books()
        short = found.select(T.clip(F.col("book_id"), 8).alias("id"), T.clip(F.col("title"), 40).alias("title"), F.substring(F.array_join("authors", ", "), 1, 30).alias("authors"), F.array_join(F.slice("tags", 1, 3), ", ").alias("tags"), "difficulty_level")
        show(found if given.json else short, given.json)
    elif given.verb == "delete":
        if not given.yes and input(f"Delete {given.book_id}? [y/N] ").strip().lower() != "y":
            return 1
        print(f"{library.delete_book(given.book_id)} points deleted")
    elif given.verb == "stats":
        show(library.statistics(), True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
