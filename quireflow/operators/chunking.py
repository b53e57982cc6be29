"""Chunks of long texts: a recursive splitter with overlap, fixed windows, filters, indexes and statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..staging import short_batches, staged

#: The separators, strongest first.
SEPARATORS = ("\n\n\n", "\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ", "")
#: Chunks leave a worker when it holds so many, or so many characters of them.
CHUNKS_AT_ONCE, CHARS_AT_ONCE = 4096, 1 << 20


def estimate(text: str) -> int:
    return len(text) // 4


def sizes(min_tokens: int, max_tokens: int, overlap: float, compat: bool) -> tuple[int, int]:
    """(size, overlap) in tokens that the splitter aims at.

    compat multiplies both by four, as if the length function counted characters while it counts tokens; without it the
    middle of the two limits is meant as it is.
    """
    middle = (min_tokens + max_tokens) // 2
    scale = 4 if compat else 1
    return middle * scale, int(middle * overlap) * scale


def cut(text: str, separator: str) -> list[str]:
    """Pieces of a text, each but the first beginning with the separator; without one, its characters."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [x for x in (head, *(separator + r for r in rest)) if x]


def merge(pieces: list[str], size: int, overlap: int, length: Callable[[str], int]) -> Iterator[str]:
    """Chunks of consecutive pieces up to the size; each begins with the pieces of the one before that fit the overlap.

    When pieces drop out of the overlap follows the rule of a public text splitter that the reference calls, so that cuts agree.
    """
    held: list[tuple[str, int]] = []
    total = 0
    for piece in pieces:
        n = length(piece)
        if held and total + n > size:
            if chunk := "".join(x for x, _ in held).strip():
                yield chunk
            drop = 0
            while drop < len(held) and (total > overlap or (total + n > size and total > 0)):
                total -= held[drop][1]
                drop += 1
            del held[:drop]
        held.append((piece, n))
        total += n
    if chunk := "".join(x for x, _ in held).strip():
        yield chunk


def split(text: str, size: int, overlap: int, length: Callable[[str], int] = estimate, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of a text by the first separator it has; pieces that are too long are split by the ones after it."""
    at = next((k for k, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    weaker = separators[at + 1 :]
    out: list[str] = []
    run: list[str] = []
    for piece in cut(text, separators[at]):
        if length(piece) < size:
            run.append(piece)
            continue
        if run:
            out += merge(run, size, overlap, length)
            run = []
        out += split(piece, size, overlap, length, weaker) if weaker else [piece]
    return out + list(merge(run, size, overlap, length))


def cutter(keys: list[str], size: int, overlap: int, length: Callable[[str], int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of batches (keys, text) that gives (keys, position, n_raw, content), a bounded number of chunks at once."""

    def made(batch: pa.RecordBatch, row: list[int], place: list[int], total: list[int], found: list[str]) -> pa.RecordBatch:
        taken = [c.take(pa.array(row, pa.int32())) for c in batch.columns[: len(keys)]]
        return pa.RecordBatch.from_arrays([*taken, pa.array(place, pa.int32()), pa.array(total, pa.int32()), pa.array(found, pa.string())], names=[*keys, "position", "n_raw", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, place, total, found, held = [], [], [], [], 0
            for i, body in enumerate(batch.column(len(keys))):
                text = body.as_py()
                chunks = split(text, size, overlap, length) if text and text.strip() else []
                row += [i] * len(chunks)
                place += range(len(chunks))
                total += [len(chunks)] * len(chunks)
                found += chunks
                held += sum(map(len, chunks))
                if held >= CHARS_AT_ONCE or len(row) >= CHUNKS_AT_ONCE:
                    yield made(batch, row, place, total, found)
                    row, place, total, found, held = [], [], [], [], 0
            yield made(batch, row, place, total, found)

    return run


def recursive(texts: DataFrame, keys: list[str], text: str = "content", min_tokens: int = 500, max_tokens: int = 2000, overlap: float = 0.2, compat: bool = True) -> DataFrame:
    """(keys, position, n_raw, content, token_count): every chunk of every text that isn't blank.

    Chunks under min_tokens go, unless they are the last of their text; position counts from 0 before that filter. A worker
    holds a short batch of texts and the chunks of some of them, or of one longer text.
    """
    short_batches(texts.sparkSession)
    size, shared = sizes(min_tokens, max_tokens, overlap, compat)
    length = estimate if compat else lambda s: -(-len(s) // 4)
    fields = {f.name: f.dataType.simpleString() for f in texts.select(*keys).schema}

    types = ", ".join(f"`{k}` {t}" for k, t in fields.items())
    chunks = texts.select(*keys, F.col(text).alias("content")).mapInArrow(cutter(keys, size, shared, length), f"{types}, position int, n_raw int, content string")
    return chunks.withColumn("token_count", T.token_estimate(F.col("content"))).filter((F.col("token_count") >= min_tokens) | (F.col("position") == F.col("n_raw") - 1))


def fixed(texts: DataFrame, keys: list[str], text: str = "content", chars: int = 1000, step: int = 800, min_tokens: int = 0) -> DataFrame:
    """Windows of `chars` characters every `step`, with the same filter; column expressions only."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.length("body") - chars) / step), F.lit(0)).cast("int"))
    cuts = texts.select(*keys, F.col(text).alias("body")).filter(~T.blank(F.col("body"))).select(*keys, "body", F.size(starts).alias("n_raw"), F.posexplode(starts).alias("position", "k"))
    chunks = cuts.select(*keys, "position", "n_raw", T.strip(F.substring(F.col("body"), F.col("k") * step + 1, F.lit(chars))).alias("content")).filter("content <> ''")
    return chunks.withColumn("token_count", T.token_estimate(F.col("content"))).filter((F.col("token_count") >= min_tokens) | (F.col("position") == F.col("n_raw") - 1))


def indexed(chunks: DataFrame, book: list[str], chapter: str) -> DataFrame:
    """local_index and total_chunks within a chapter, chunk_index and total_document_chunks within the whole book.

    A chapter's chunks are counted, the counts are summed over the chapters of the book, and a chunk's place is its own in
    the chapter plus what comes before the chapter. So a window holds the chunks of a chapter or a book's chapters, never
    a book's chunks. chunks is read twice; stage it where it costs much.
    """
    keys = [*book, chapter]
    counts = chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_chunks"))
    whole = Window.partitionBy(*book)
    before = F.coalesce(F.sum("total_chunks").over(whole.orderBy(chapter).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.withColumn("_before", before).withColumn("total_document_chunks", F.sum("total_chunks").over(whole))
    same = [chunks[k].eqNullSafe(places[k]) for k in keys]
    own = chunks.join(places, same).drop(*[places[k] for k in keys])
    local = F.row_number().over(Window.partitionBy(*keys).orderBy("position")) - 1
    placed = own.withColumn("local_index", local).withColumn("chunk_index", (F.col("local_index") + F.col("_before")).cast("int"))
    return placed.select(*chunks.columns, "local_index", "total_chunks", "chunk_index", "total_document_chunks")


def chunk_books(books: DataFrame, chapters: DataFrame, preserve_structure: bool = True, strategy: str = "recursive", **how) -> DataFrame:
    """Chunks by chapter where a book has any and structure counts, else of its whole text; indexed over the book.

    The strategy is recursive, or fixed for windows of the middle size that overlap by its share; both drop short chunks.
    """
    if strategy not in ("recursive", "fixed"):
        raise ValueError(f"unknown strategy {strategy}")
    own = chapters.select("book_id", F.col("number").alias("chapter_number"), F.col("title").alias("chapter_title"), F.nullif("start_page", F.lit(0)).alias("start_page"), F.nullif("end_page", F.lit(0)).alias("end_page"), F.lit("chapter").alias("source_type"), "content")
    whole = books.select("book_id", F.lit(0).alias("chapter_number"), F.lit(None).cast("string").alias("chapter_title"), F.lit(None).cast("int").alias("start_page"), F.lit(None).cast("int").alias("end_page"), F.lit("full_document").alias("source_type"), F.col("raw_text").alias("content"))
    texts = own.unionByName(whole.join(chapters.select("book_id").distinct(), "book_id", "left_anti")) if preserve_structure else whole
    keys = ["book_id", "chapter_number", "chapter_title", "start_page", "end_page", "source_type"]
    if strategy == "fixed":
        low, high, overlap = how.get("min_tokens", 500), how.get("max_tokens", 2000), how.get("overlap", 0.2)
        chars = 2 * (low + high)  # four characters to a token
        chunks = fixed(texts, keys, chars=chars, step=max(1, chars - int(chars * overlap)), min_tokens=low)
    else:
        chunks = recursive(texts, keys, **how)
    return indexed(staged(chunks, "chunks"), ["book_id"], "chapter_number")


def statistics(chunks: DataFrame) -> DataFrame:
    """Number of chunks, and sum, floored average, least and most of their tokens; zeros for none."""
    n, total = F.count(F.lit(1)), F.coalesce(F.sum("token_count"), F.lit(0))
    return chunks.agg(n.alias("total_chunks"), total.alias("total_tokens"), F.coalesce(F.floor(total / F.nullif(n, F.lit(0))), F.lit(0)).cast("long").alias("avg_tokens"), F.coalesce(F.min("token_count"), F.lit(0)).alias("min_tokens"), F.coalesce(F.max("token_count"), F.lit(0)).alias("max_tokens"))
