"""Queries of model answers: normal forms of JSON that is made from the tables, deduplication, merging and assembly."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import model_output as M
from ..functions import text as T
from ..operators import analysis as A
from .registry import Tables, query


@query(
    "concept_dedup",
    """WITH c AS (SELECT p_partkey % 50 AS book, p_partkey AS pos, CASE p_partkey % 3 WHEN 0 THEN upper(split_part(p_name, ' ', 1)) WHEN 1 THEN '  ' || split_part(p_name, ' ', 1) ELSE split_part(p_name, ' ', 1) END AS term, p_type || repeat('x', (p_partkey % 4)::INT) AS definition FROM part),
    d AS (SELECT *, lower(trim(term)) AS key FROM c WHERE trim(term) <> ''),
    b AS (SELECT book, key, min(pos) AS first_pos, arg_max(term, (length(definition), -pos)) AS term, arg_max(definition, (length(definition), -pos)) AS definition FROM d GROUP BY book, key)
    SELECT book, (row_number() OVER (PARTITION BY book ORDER BY first_pos))::INT AS ord, term, definition FROM b QUALIFY row_number() OVER (PARTITION BY book ORDER BY first_pos) <= 30""",
)
def concept_dedup(t: Tables) -> DataFrame:
    word, kind = F.split_part("p_name", F.lit(" "), F.lit(1)), F.col("p_partkey") % 3
    term = F.when(kind == 0, F.upper(word)).when(kind == 1, F.concat(F.lit("  "), word)).otherwise(word)
    concepts = t.part.select((F.col("p_partkey") % 50).alias("book"), F.col("p_partkey").alias("pos"), term.alias("term"), F.concat("p_type", F.repeat(F.lit("x"), (F.col("p_partkey") % 4).cast("int"))).alias("definition"))
    return A.distinct_concepts(concepts, ["book"])


ANSWER = """answers AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'no JSON here' ELSE 'ok' END AS kind, split_part(text, ' ', 1) AS a, split_part(text, ' ', 2) AS b, lang FROM documents)"""


def answers(t: Tables, body: F.Column, agent: str) -> DataFrame:
    """Answers of an agent for each document: every sixth call failed, and every sixth said no JSON."""
    kind = F.col("doc_id") % 6
    answer = F.when(kind == 1, "no JSON here").when(kind != 0, F.to_json(body))
    rows = t.documents.select("doc_id", F.lit(agent).alias("agent"), answer.alias("answer"), F.when(kind == 0, "exception").otherwise("ok").alias("status"), F.lit(None).cast("string").alias("error"))
    return A.normalised(rows)


def word(n: int) -> F.Column:
    return F.split_part("text", F.lit(" "), F.lit(n))


def joined(*columns: str) -> list[F.Column]:
    return [F.array_join(c, "|").alias(c) for c in columns]


@query(
    "agent_normalise_genre",
    f"""WITH {ANSWER} SELECT doc_id,
        CASE WHEN kind = 'ok' THEN array_to_string(list_filter([trim(a), trim(b), lang, 'fourth'], lambda x: x <> '')[1:3], '|') ELSE '' END AS genres, CASE WHEN kind = 'ok' THEN lang ELSE '' END AS tags,
        CASE WHEN kind IS NULL THEN '' WHEN kind = 'ok' THEN a ELSE 'general' END AS target_audience, CASE WHEN kind IS NULL THEN '' ELSE 'intermediate' END AS difficulty_level
        FROM answers""",
)
def normalise_genre(t: Tables) -> DataFrame:
    body = F.struct(F.array(word(1), word(2), F.col("lang"), F.lit("fourth")).alias("genres"), F.col("lang").alias("tags"), word(1).alias("target_audience"))
    return A.form(answers(t, body, "genre_tags"), "genre_tags", ("doc_id",)).select("doc_id", *joined("genres", "tags"), "target_audience", "difficulty_level")


@query("agent_normalise_overview", f"WITH {ANSWER} SELECT doc_id, CASE WHEN kind = 'ok' THEN a || ' ' || b ELSE '' END AS summary, CASE WHEN kind = 'ok' THEN lang ELSE '' END AS main_topics, CASE WHEN kind = 'ok' THEN '1|2|3|4|5|6|7' ELSE '' END AS key_takeaways FROM answers")
def normalise_overview(t: Tables) -> DataFrame:
    body = F.struct(F.concat_ws(" ", word(1), word(2)).alias("summary"), F.col("lang").alias("main_topics"), F.array(*[F.lit(str(k)) for k in range(1, 10)]).alias("key_takeaways"))
    return A.form(answers(t, body, "overview"), "overview", ("doc_id",)).select("doc_id", "summary", *joined("main_topics", "key_takeaways"))


@query("agent_normalise_themes", f"WITH {ANSWER} SELECT doc_id, CASE WHEN kind = 'ok' THEN lang || '|Unknown' ELSE '' END AS primary_names, CASE WHEN kind = 'ok' THEN 'd1|' ELSE '' END AS primary_texts, CASE WHEN kind = 'ok' THEN 's1|s2|s3|s4' ELSE '' END AS secondary_names FROM answers")
def normalise_themes(t: Tables) -> DataFrame:
    first = F.to_json(F.struct(F.col("lang").alias("name"), F.lit("d1").alias("description")))
    raw = F.concat(F.lit('{"primary_themes": ['), first, F.lit(', {"other": 1}, 7, null], "secondary_themes": ["s1", "s2", "s3", "s4", "s5"]}'))
    kind = F.col("doc_id") % 6
    rows = t.documents.select("doc_id", F.lit("themes").alias("agent"), F.when(kind == 1, "no JSON here").when(kind != 0, raw).alias("answer"), F.when(kind == 0, "exception").otherwise("ok").alias("status"))
    found = A.form(A.normalised(rows), "themes", ("doc_id",))
    names = lambda c, f: F.array_join(F.transform(c, lambda x: x[f]), "|")
    return found.select("doc_id", names("primary_themes", "name").alias("primary_names"), names("primary_themes", "description").alias("primary_texts"), names("secondary_themes", "name").alias("secondary_names"))


@query("agent_normalise_chapter", f"WITH {ANSWER} SELECT doc_id, CASE WHEN kind = 'ok' THEN a ELSE '' END AS summary, CASE WHEN kind = 'ok' THEN 'p1|p2|p3|p4|p5' ELSE '' END AS key_points FROM answers")
def normalise_chapter(t: Tables) -> DataFrame:
    body = F.struct(word(1).alias("summary"), F.array(*[F.lit(f" p{k} ") for k in range(1, 8)]).alias("key_points"))
    return A.form(answers(t, body, "chapter_summary"), "chapter_summary", ("doc_id",)).select("doc_id", "summary", *joined("key_points"))


@query(
    "agent_normalise_quotes",
    """WITH q AS (SELECT lang || '/' || source AS book_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS number, doc_id, split_part(text, ' ', 1) AS a FROM documents),
    e AS (SELECT book_id, number, doc_id, unnest([0, 1]) AS pos, a FROM q WHERE doc_id % 6 > 1), f AS (SELECT *, CASE WHEN pos = 0 THEN a ELSE 'second' END AS text FROM e), g AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY number, pos) AS ord FROM f WHERE text <> '')
    SELECT book_id, ord::INT AS ord, text, 'Doc ' || doc_id AS chapter FROM g WHERE ord <= 15""",
)
def normalise_quotes(t: Tables) -> DataFrame:
    from .q_chapters import chapters

    kind = F.col("doc_id") % 6
    text = F.split_part("content", F.lit(" "), F.lit(1))
    body = F.to_json(F.struct(F.array(F.struct(text.alias("text")), F.struct(F.lit("second").alias("text"))).alias("quotes")))
    rows = chapters(t).select(F.concat_ws("/", "lang", "source").alias("book_id"), "number", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), F.lit("key_quotes").alias("agent"), F.when(kind == 1, "no JSON here").when(kind != 0, body).alias("answer"), F.when(kind == 0, "exception").otherwise("ok").alias("status"))
    return A.quotes(A.normalised(rows)).select("book_id", "ord", "text", "chapter")


@query(
    "bibliography_merge",
    """WITH f AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE c_name END AS title, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS publisher, CASE WHEN c_custkey % 5 = 0 THEN 1999 END AS y FROM customer)
    SELECT c.c_custkey, coalesce(nullif(f.title, ''), CASE WHEN c.c_custkey % 7 <> 0 THEN 'meta ' || c.c_custkey END, 'Unknown') AS title, coalesce(f.publisher, 'house') AS publisher,
        coalesce(f.y, TRY_CAST(substring(CASE WHEN c.c_custkey % 4 = 0 THEN 'n.d.' ELSE (1900 + c.c_custkey % 100) || '-05-01' END, 1, 4) AS INT)) AS publication_year, CASE WHEN c.c_custkey % 2 = 0 THEN 'A|B' ELSE 'M' END AS authors
        FROM customer c JOIN f ON f.c_custkey = c.c_custkey""",
)
def bibliography_merge(t: Tables) -> DataFrame:
    key, none = F.col("c_custkey"), F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    found = t.customer.select(
        key.alias("book_id"), F.when(key % 3 == 0, "").when(key % 3 == 2, F.col("c_name")).alias("title"), F.when(key % 2 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(empty).alias("authors"), empty.alias("subjects"), F.when(key % 2 == 0, F.col("c_mktsegment")).alias("publisher"),
        none.alias("isbn"), none.alias("isbn13"), none.alias("language"), none.alias("description"), F.when(key % 5 == 0, 1999).alias("publication_year"), none.alias("edition"), none.alias("series"), F.lit(None).cast("int").alias("series_number"),
    )
    date = F.when(key % 4 == 0, "n.d.").otherwise(F.concat((1900 + key % 100).cast("string"), F.lit("-05-01")))
    meta = t.customer.select(key.alias("book_id"), F.when(key % 7 != 0, F.concat(F.lit("meta "), key.cast("string"))).alias("title"), F.array(F.lit("M")).alias("authors"), empty.alias("subjects"), F.lit("house").alias("publisher"), none.alias("isbn"), none.alias("isbn13"), none.alias("language"), none.alias("description"), date.alias("date"))
    return A.merged_bibliography(found, meta).select(F.col("book_id").alias("c_custkey"), "title", "publisher", "publication_year", F.array_join("authors", "|").alias("authors"))


@query(
    "analysis_assemble_left_defaults",
    """SELECT d.doc_id AS book_id, CASE WHEN l.doc_id IS NULL OR l.quality = 0 THEN '' ELSE 'g' || l.quality END AS genres, CASE WHEN l.doc_id IS NULL THEN '' WHEN l.quality = 0 THEN 'intermediate' WHEN l.toxic = 1 THEN 'expert' ELSE 'intermediate' END AS difficulty_level,
    CASE WHEN l.doc_id IS NULL OR l.toxic = 0 THEN '' ELSE 'told of ' || d.doc_id END AS summary FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def assemble_defaults(t: Tables) -> DataFrame:
    """Labelled documents have answers: without JSON where the quality is 0, and no overview where nothing is toxic."""
    genre = F.when(F.col("quality") == 0, "no JSON").otherwise(F.to_json(F.struct(F.array(F.concat(F.lit("g"), F.col("quality").cast("string"))).alias("genres"), F.when(F.col("toxic") == 1, "expert").alias("difficulty_level"))))
    told = F.to_json(F.struct(F.concat(F.lit("told of "), F.col("doc_id").cast("string")).alias("summary")))
    own = t.labels.select(F.col("doc_id").alias("book_id"), F.explode(F.array(F.struct(F.lit("genre_tags").alias("agent"), genre.alias("answer")), F.struct(F.lit("overview").alias("agent"), F.when(F.col("toxic") == 1, told).alias("answer")))).alias("x")).select("book_id", "x.*")
    rows = A.normalised(own.withColumn("status", F.when(F.col("answer").isNull(), "exception").otherwise("ok")))
    return A.assembled(t.documents.select(F.col("doc_id").alias("book_id")), rows).select("book_id", *joined("genres"), "difficulty_level", "summary")


@query("ocr_and_class", "SELECT vec_id, CASE WHEN label = 0 THEN '' ELSE 'text ' || vec_id END AS ocr_text, CASE WHEN label = 1 THEN 'unknown' ELSE 'chart' || label END AS image_type FROM embeddings")
def ocr_and_class(t: Tables) -> DataFrame:
    name = F.col("vec_id").cast("string")
    ocr = F.when(F.col("label") == 0, F.lit(" no_text\n")).otherwise(F.concat(F.lit(" text "), name, F.lit("\n")))
    kind = F.when(F.col("label") != 1, F.concat(F.lit("Chart"), F.col("label").cast("string"), F.lit(" ")))
    return t.embeddings.select("vec_id", M.ocr_text(ocr).alias("ocr_text"), M.image_class(kind).alias("image_type"))


@query("analyze_books")
def analyze_books(t: Tables) -> DataFrame:
    """All agents of books, chapters and images, with the analyzer that needs no model, over books of documents.

    Every fiftieth document's text stands for the bytes of an image.
    """
    from ..staging import short_batches, staged
    from .q_chapters import BOOK, chapters

    short_batches(t.spark)
    own = chapters(t).withColumn("title", F.concat(F.lit("Chapter "), F.col("number").cast("string")))
    keyed = staged(own.withColumn("book_id", F.concat_ws("/", *BOOK)), "chapters")  # numbered once, for all that read them
    # every book has chapters, so no agent reads a whole text, and none is put together; a blank line ends a word
    books = keyed.groupBy(*BOOK, "book_id").agg(F.sum(T.word_count(F.col("content"))).alias("word_count")).withColumn("raw_text", F.lit(None).cast("string"))
    rows = A.normalised(A.answered(A.windows(books, keyed), A.WordAnalyzer()))
    by_chapter = A.normalised(A.answered(A.chapter_windows(keyed, books=books), A.WordAnalyzer()).persist(StorageLevel.DISK_ONLY))  # read by each list
    none = F.lit(None).cast("int")
    images = keyed.filter("doc_id % 50 = 0").select("book_id", F.col("number").alias("ord"), F.concat("title", F.lit(".png")).alias("filename"), F.lit("image/png").alias("content_type"), none.alias("width"), none.alias("height"), none.alias("page_number"), T.base64_text(F.col("content").cast("binary")).alias("base64_data"))
    described = A.image_descriptions(images, A.answered(A.image_calls(images), A.WordAnalyzer()))
    found = A.assembled(books, rows, by_chapter, described)
    lists = ("technical_concepts", "key_quotes", "chapter_summaries", "image_descriptions")
    return found.select("book_id", "genres", "tags", "difficulty_level", "summary", "main_topics", F.transform("primary_themes", lambda x: x["name"]).alias("themes"), *lists)


@query("analyze_chapters")
def analyze_chapters(t: Tables) -> DataFrame:
    """Concepts of the first chapters of each book: one call a chapter, then reduced to a book's distinct terms."""
    from .q_chapters import BOOK, chapters

    keyed = chapters(t).withColumn("book_id", F.concat_ws("/", *BOOK)).withColumn("title", F.concat(F.lit("Chapter "), F.col("number").cast("string")))
    rows = A.normalised(A.answered(A.chapter_windows(keyed, ("technical_concepts",)), A.WordAnalyzer()))
    return A.distinct_concepts(A.concept_rows(rows), ["book_id"])
