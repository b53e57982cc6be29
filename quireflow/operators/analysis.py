"""Model analyses of books: pluggable analyzers in Arrow batches, then normal forms as column expressions.

An analyzer answers with raw text for (agent, input). What a model says is kept as it came, with a status, so the normal
forms can be tested and changed without calling a model again. The analyzer that is built in needs no model: it counts words.
"""

from __future__ import annotations

import heapq
import json
import re
import time
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import model_output as M
from ..functions import text as T

BOOK_AGENTS = ("bibliography", "genre_tags", "overview", "themes")
CHAPTER_AGENTS = ("technical_concepts", "key_quotes", "chapter_summary")
IMAGE_AGENTS = ("describe", "ocr", "classify")
#: The tags that a library offers where the settings name none.
DEFAULT_TAGS = (
    "Information Security", "Python", "AI/Machine Learning", "Web Development", "Systems Programming", "Networking", "Databases", "DevOps", "Cryptography", "Reverse Engineering", "Game Development", "Mobile Development",
    "Cloud Computing", "Data Science", "Software Engineering", "Linux/Unix", "Hardware", "Electronics", "Robotics", "Mathematics", "Science", "Business", "Design", "Writing",
)
#: How many contents items each agent sees, and how many chapters are listed for the overview.
CONTENTS = {"genre_tags": 20, "overview": 30, "themes": 25}
LISTED_CHAPTERS = 20
#: Fixed values, how much each agent reads: chapters of a book (0: all) and characters of each; without chapters, characters of the whole.
WINDOWS = {"bibliography": (2, 5000), "genre_tags": (3, 8000), "overview": (5, 8000), "themes": (5, 8000), "technical_concepts": (8, 12000), "key_quotes": (10, 12000), "chapter_summary": (0, 15000)}
WHOLE_CHARS = 40000
ATTEMPTS, LEAST_WAIT_S, MOST_WAIT_S = 3, 2.0, 30.0
ANSWERS = "agent string, answer string, status string, error string"


class Analyzer(Protocol):
    """Answers with the raw text of a model. It travels to the workers, so it must pickle."""

    def analyze(self, agent: str, text: str) -> str: ...


class ChatAnalyzer:
    """Asks a chat model behind an HTTP interface with /chat/completions; images go as data URIs.

    What an agent is asked for is in prompts, by name; an agent without one is asked with its name.
    """

    def __init__(self, base_url: str, model: str, max_tokens: int = 4096, temperature: float = 0.3, timeout: float = 120.0, prompts: dict[str, str] | None = None, key: str = ""):
        self.base_url, self.model, self.max_tokens, self.temperature, self.timeout, self.prompts, self.key = base_url.rstrip("/"), model, max_tokens, temperature, timeout, prompts or {}, key

    def analyze(self, agent: str, text: str) -> str:
        from urllib.request import Request, urlopen

        content: object = [{"type": "image_url", "image_url": {"url": text}}] if agent in IMAGE_AGENTS else text
        messages = [{"role": "system", "content": self.prompts.get(agent, f"You are the agent {agent}. Answer with one JSON object.")}, {"role": "user", "content": content}]
        body = {"model": self.model, "messages": messages, "max_tokens": self.max_tokens, "temperature": self.temperature}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        with urlopen(Request(f"{self.base_url}/chat/completions", json.dumps(body).encode(), headers), timeout=self.timeout) as reply:
            return json.load(reply)["choices"][0]["message"]["content"] or ""


class Committee:
    """Two analyzers as one: the second one looks at images."""

    def __init__(self, text: Analyzer, images: Analyzer):
        self.text, self.images = text, images

    def analyze(self, agent: str, text: str) -> str:
        return (self.images if agent in IMAGE_AGENTS else self.text).analyze(agent, text)


class WordAnalyzer:
    """A deterministic analyzer without a model: frequent long words, first sentences. Of a book it reads the sample."""

    def analyze(self, agent: str, text: str) -> str:
        if agent in IMAGE_AGENTS:  # it reads no images
            return {"describe": "", "ocr": "NO_TEXT", "classify": "unknown"}[agent]
        text = text.partition("Sample:\n")[2] if agent in BOOK_AGENTS and "Sample:\n" in text else text
        counts: Counter[str] = Counter()
        for w, n in Counter(re.findall(r"[^\W\d_]{5,}", text)).items():
            counts[w.lower()] += n
        top = heapq.nsmallest(12, counts, key=lambda w: (-counts[w], w))
        sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]
        first = sentences[0][:300] if sentences else ""
        forms: dict[str, object] = {
            "bibliography": {"title": first[:80] or None, "authors": [], "subjects": top[:3]},
            "genre_tags": {"genres": top[:3], "tags": top[:10], "target_audience": "general", "difficulty_level": "intermediate", "prerequisites": []},
            "overview": {"summary": " ".join(sentences[:3])[:1000], "main_topics": top[:10], "key_takeaways": sentences[:3], "unique_value": "", "writing_style": "", "practical_applications": []},
            "themes": {"primary_themes": [{"name": w, "description": ""} for w in top[:5]], "secondary_themes": top[5:9], "recurring_ideas": top[:3]},
            "technical_concepts": {"concepts": [{"term": w, "definition": f"a word used {counts[w]} times", "category": "word"} for w in top[:5]]},
            "key_quotes": {"quotes": [{"text": max(sentences, key=len, default="")[:300], "context": "", "significance": "longest sentence"}]},
            "chapter_summary": {"summary": first, "key_points": sentences[:5], "concepts_introduced": top[:5], "practical_examples": []},
        }
        return json.dumps(forms.get(agent, {"text": first}))


def windows(books: DataFrame, chapters: DataFrame, agents: tuple[str, ...] = BOOK_AGENTS, toc: DataFrame | None = None, tags: tuple[str, ...] = DEFAULT_TAGS) -> DataFrame:
    """(book_id, agent, input) for agents that read a book: what is known of it, and its first chapters, or its text where it has none.

    One pass over the chapters serves all agents: a chapter is ranked in its book once, and goes to those that read so far.
    books has raw_text, which is read of books without chapters only, and what it has of title, word_count and metadata.
    toc has (book_id, seq, level, title), levels from 0. An agent that isn't in WINDOWS is an error.
    """
    if unknown := set(agents) - set(WINDOWS):
        raise ValueError(f"unknown agents {sorted(unknown)}")
    most = max(LISTED_CHAPTERS, *(WINDOWS[a][0] for a in agents))
    words = F.col("word_count") if "word_count" in chapters.columns else T.word_count(F.col("content"))
    rank = F.row_number().over(Window.partitionBy("book_id").orderBy("number"))
    first = chapters.select("book_id", "number", "title", "content", words.alias("words")).withColumn("rank", rank).filter(F.col("rank") <= most)
    reads = F.explode(F.array(*[F.struct(F.lit(a).alias("agent"), F.lit(WINDOWS[a][0]).alias("n"), F.lit(WINDOWS[a][1]).alias("limit")) for a in agents]))
    own = first.withColumn("read", reads).withColumn("agent", F.col("read.agent"))
    piece = F.when(F.col("rank") <= F.col("read.n"), F.concat(F.lit("## "), "title", F.lit("\n\n"), F.when(F.length("content") <= F.col("read.limit"), F.col("content")).otherwise(F.concat(F.substring(F.col("content"), F.lit(1), F.col("read.limit")), F.lit("...")))))
    line = F.when(F.col("agent") == "overview", T.chapter_line(F.col("title"), F.col("words")))
    sample = own.withColumn("piece", piece).withColumn("line", line).groupBy("book_id", "agent").agg(T.ordered_concat(F.col("number"), F.col("piece"), "\n\n---\n\n").alias("sample"), T.ordered_concat(F.col("number"), F.col("line"), "\n").alias("chapter_list"))
    every = F.explode(F.array(*[F.lit(a) for a in agents])).alias("agent")
    known = [c for c in ("title", "word_count", "authors", "publisher", "date", "language", "isbn", "isbn13", "description", "subjects") if c in books.columns]
    bare = books.join(chapters.select("book_id").distinct(), "book_id", "left_anti").select("book_id", F.substring("raw_text", 1, WHOLE_CHARS).alias("whole"))
    found = books.select("book_id", *known, every).join(sample, ["book_id", "agent"], "left").join(bare, "book_id", "left")
    if toc is not None:
        items = toc.select("book_id", "seq", "level", "title").withColumn("rank", F.row_number().over(Window.partitionBy("book_id").orderBy("seq"))).filter(F.col("rank") <= max(CONTENTS.values()))
        listed_items = items.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("rank", "level", F.col("title").alias("item")))).alias("toc"))
        found = found.join(listed_items, "book_id", "left")
    else:
        found = found.withColumn("toc", F.lit(None).cast("array<struct<rank: int, level: int, item: string>>"))
    upto = F.create_map(*[F.lit(x) for pair in CONTENTS.items() for x in pair])
    entries = F.transform(F.slice(F.col("toc"), F.lit(1), F.coalesce(F.try_element_at(upto, F.col("agent")), F.lit(1))), lambda e: F.struct(e.level.alias("level"), F.nullif(e["item"], F.lit("")).alias("title")))
    contents = F.when(F.col("agent") == "overview", T.toc_lines(entries, True)).otherwise(T.toc_lines(entries))
    told = lambda c: F.array_join(c, ", ") if dict(found.dtypes).get(c, "").startswith("array") else F.col(c).cast("string")
    parts = {
        "Title": F.when(F.col("agent") != "bibliography", F.coalesce(told("title"), F.lit("Unknown"))) if "title" in known else F.lit(None).cast("string"),
        "Words": F.when(F.col("agent") == "overview", F.coalesce(told("word_count"), F.lit("Unknown"))) if "word_count" in known else F.lit(None).cast("string"),
        "Metadata": F.when(F.col("agent") == "bibliography", T.metadata_lines({c: told(c) for c in known if c != "word_count"})),
        "Tags": F.when(F.col("agent") == "genre_tags", F.lit(", ".join(tags))),
        "Contents": F.when(F.col("agent").isin(*CONTENTS), F.coalesce(F.nullif(contents, F.lit("")), F.lit("Not available"))),
        "Chapters": F.when(F.col("agent") == "overview", F.coalesce(F.nullif("chapter_list", F.lit("")), F.lit("Not available"))),
        "Sample": F.coalesce("sample", "whole", F.lit("")),
    }
    return found.select("book_id", "agent", F.concat_ws("\n\n", *[F.concat(F.lit(f"{name}:\n"), c) for name, c in parts.items()]).alias("input"))


def chapter_windows(chapters: DataFrame, agents: tuple[str, ...] = CHAPTER_AGENTS, books: DataFrame | None = None) -> DataFrame:
    """(book_id, number, title, agent, input): one call for each chapter that an agent reads.

    With books, a book without chapters has one call of its text for each agent but chapter_summary, as number 0 without a title.
    """
    rank = F.row_number().over(Window.partitionBy("book_id").orderBy("number"))
    held = chapters.select("book_id", "number", "title", "content")
    made = []
    for all_read in (True, False):  # who reads every chapter needs no rank, so only a book's first chapters are ranked and moved
        of = [a for a in agents if (WINDOWS[a][0] == 0) == all_read]
        if of:
            calls = F.explode(F.array(*[F.struct(F.lit(a).alias("agent"), F.lit(WINDOWS[a][0]).alias("n"), F.lit(WINDOWS[a][1]).alias("limit")) for a in of]))
            ranked = held.withColumn("rank", F.lit(0)) if all_read else held.withColumn("rank", rank).filter(F.col("rank") <= max(WINDOWS[a][0] for a in of))
            each = ranked.withColumn("call", calls).filter(F.col("rank") <= F.col("call.n"))
            made.append(each.select("book_id", "number", "title", F.col("call.agent").alias("agent"), F.substring(F.col("content"), F.lit(1), F.col("call.limit")).alias("input")))
    found = made[0].unionByName(made[-1]) if len(made) > 1 else made[0]
    whole = [a for a in agents if a != "chapter_summary"]
    if books is None or not whole:
        return found
    bare = books.join(chapters.select("book_id").distinct(), "book_id", "left_anti")
    return found.unionByName(bare.select("book_id", F.lit(0).alias("number"), F.lit("").alias("title"), F.explode(F.array(*[F.lit(a) for a in whole])).alias("agent"), F.substring("raw_text", 1, WHOLE_CHARS).alias("input")))


def answered(calls: DataFrame, analyzer: Analyzer, threads: int = 6, attempts: int = ATTEMPTS, wait_s: float = LEAST_WAIT_S) -> DataFrame:
    """calls (with agent and input) plus answer, status (ok, exception) and error; a failed call fails alone.

    Rows of a batch are sent by a few threads at once, each tried again after rising waits.
    """
    held = [c for c in calls.columns if c != "input"]

    def call(agent: str, text: str) -> tuple[str | None, str, str | None]:
        for k in range(attempts):
            try:
                return analyzer.analyze(agent, text or ""), "ok", None
            except Exception as e:  # a model may fail in any way; the row says how
                if k + 1 == attempts:
                    return None, "exception", f"{type(e).__name__}: {e}"
                time.sleep(min(wait_s * 2**k, MOST_WAIT_S))
        return None, "exception", "no attempt"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                found = list(pool.map(call, batch["agent"], batch["input"]))
                yield batch[held].assign(**{name: [x[k] for x in found] for k, name in enumerate(("answer", "status", "error"))})

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in calls.select(*held).schema)
    return calls.mapInPandas(run, f"{types}, answer string, status string, error string")


def normalised(raw: DataFrame) -> DataFrame:
    """Answers with `json` as a variant; an answer that is no JSON gets the status parse_error."""
    clean = raw.withColumn("clean", M.strict_json(F.col("answer")))
    return clean.withColumn("status", F.when((F.col("status") == "ok") & F.col("clean").isNull(), "parse_error").otherwise(F.col("status"))).withColumn("json", M.parsed(F.col("clean"))).drop("clean")


def genre_tags(v: Column, status: Column) -> dict[str, Column]:
    return {
        "genres": M.list_at(v, "genres", M.GENRES),
        "tags": M.list_at(v, "tags", M.TAGS),
        "target_audience": M.defaulted(M.text_at(v, "target_audience"), status, "general"),
        "difficulty_level": M.defaulted(M.text_at(v, "difficulty_level"), status, "intermediate"),
        "prerequisites": M.list_at(v, "prerequisites"),
    }


def overview(v: Column, status: Column) -> dict[str, Column]:
    text = {k: F.coalesce(M.text_at(v, k), F.lit("")) for k in ("summary", "unique_value", "writing_style")}
    return text | {"main_topics": M.list_at(v, "main_topics", M.TOPICS), "key_takeaways": M.list_at(v, "key_takeaways", M.TAKEAWAYS), "practical_applications": M.list_at(v, "practical_applications")}


def themes(v: Column, status: Column) -> dict[str, Column]:
    return {"primary_themes": M.themes_at(v, "primary_themes", M.PRIMARY_THEMES), "secondary_themes": M.themes_at(v, "secondary_themes", M.SECONDARY_THEMES), "recurring_ideas": M.list_at(v, "recurring_ideas")}


def chapter_summary(v: Column, status: Column) -> dict[str, Column]:
    return {"summary": F.coalesce(M.text_at(v, "summary"), F.lit("")), "key_points": M.list_at(v, "key_points", M.KEY_POINTS), "concepts_introduced": M.list_at(v, "concepts_introduced"), "practical_examples": M.list_at(v, "practical_examples")}


def bibliography(v: Column, status: Column) -> dict[str, Column]:
    text = ("publisher", "isbn", "isbn13", "language", "description", "edition", "series")
    numbers = {k: F.try_variant_get(v, f"$.{k}", "int") for k in ("publication_year", "series_number")}
    return {"title": F.coalesce(M.text_at(v, "title"), F.lit("Unknown")), "authors": M.list_at(v, "authors"), "subjects": M.list_at(v, "subjects")} | {k: M.text_at(v, k) for k in text} | numbers


def key_quotes(v: Column, status: Column) -> dict[str, Column]:
    """The quotes of one answer that have a text, as a list; `quotes` puts those of a book together."""
    return {"quotes": F.filter(M.structs_at(v, "quotes", QUOTE), lambda q: F.coalesce(q.text, F.lit("")) != "")}


def technical_concepts(v: Column, status: Column) -> dict[str, Column]:
    """The concepts of one answer as a list; `concept_rows` has those of a book."""
    return {"concepts": M.structs_at(v, "concepts", CONCEPT)}


QUOTE, CONCEPT = "text: string, context: string, significance: string", "term: string, definition: string, category: string, importance: string"
FORMS = {f.__name__: f for f in (genre_tags, overview, themes, chapter_summary, bibliography, key_quotes, technical_concepts)}


def form(rows: DataFrame, agent: str, keys: tuple[str, ...] = ("book_id",)) -> DataFrame:
    """(keys, the agent's fields) from normalised answers; an unknown agent is an error."""
    if agent not in FORMS:
        raise ValueError(f"unknown agent {agent}")
    return rows.filter(F.col("agent") == agent).select(*keys, *[c.alias(k) for k, c in FORMS[agent](F.col("json"), F.col("status")).items()])


def quotes(rows: DataFrame) -> DataFrame:
    """(book_id, ord, text, context, significance, chapter): quotes with a text, in chapter order, QUOTES of a book at most."""
    each = rows.filter("agent = 'key_quotes'").select("book_id", "number", F.col("title").alias("chapter"), F.posexplode(M.structs_at(F.col("json"), "quotes", QUOTE)).alias("pos", "q"))
    held = each.filter(F.coalesce(F.col("q.text"), F.lit("")) != "").withColumn("ord", F.row_number().over(Window.partitionBy("book_id").orderBy("number", "pos")))
    return held.filter(F.col("ord") <= M.QUOTES).select("book_id", "ord", "q.text", "q.context", "q.significance", "chapter")


def concept_rows(rows: DataFrame) -> DataFrame:
    """(book_id, pos, term, definition, category, importance) of all answers, pos in chapter order."""
    each = rows.filter("agent = 'technical_concepts'").select("book_id", "number", F.posexplode(M.structs_at(F.col("json"), "concepts", CONCEPT)).alias("k", "c"))
    filled = {"definition": "", "category": "general", "importance": "supporting"}
    return each.select("book_id", F.struct("number", "k").alias("pos"), "c.term", *[F.coalesce(F.col(f"c.{n}"), F.lit(d)).alias(n) for n, d in filled.items()])


def distinct_concepts(concepts: DataFrame, keys: list[str], most: int | None = M.CONCEPTS) -> DataFrame:
    """One row for each term but for case and outer space: its longest definition, of equal ones the first; first terms first.

    concepts has term, definition and an order column pos. Terms are reduced before rows meet, one row for each.
    """
    other = [c for c in concepts.columns if c not in (*keys, "pos")]
    key = F.lower(T.strip(F.col("term")))
    per = concepts.withColumn("key", key).filter("key <> ''").groupBy(*keys, "key").agg(F.min("pos").alias("first_pos"), F.min_by(F.struct(*other), F.struct(-F.length("definition"), F.col("pos"))).alias("best"))
    ranked = per.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy("first_pos")))
    kept = ranked if most is None else ranked.filter(F.col("ord") <= most)
    return kept.select(*keys, "ord", "best.*")


def merged_bibliography(found: DataFrame, meta: DataFrame) -> DataFrame:
    """The model's bibliography where it says something, else the file's metadata; the year from its date as a last resort."""
    both = found.alias("f").join(meta.alias("m"), "book_id", "left")
    text = ("publisher", "isbn", "isbn13", "language", "description")
    title = F.coalesce(F.nullif(F.nullif(F.col("f.title"), F.lit("")), F.lit("Unknown")), F.col("m.title"), F.lit("Unknown"))
    return both.select(
        "book_id",
        title.alias("title"),
        *[M.preferred_list(F.col(f"f.{k}"), F.col(f"m.{k}")).alias(k) for k in ("authors", "subjects")],
        *[M.preferred(F.col(f"f.{k}"), F.col(f"m.{k}")).alias(k) for k in text],
        F.coalesce("f.publication_year", M.year_of(F.col("m.date"))).alias("publication_year"),
        *[F.col(f"f.{k}") for k in ("edition", "series", "series_number")],
    )


def summaries(rows: DataFrame) -> DataFrame:
    """(book_id, number, title, the fields of chapter_summary) of each chapter."""
    return form(rows, "chapter_summary", ("book_id", "number", "title"))


def broken_books(rows: DataFrame) -> DataFrame:
    """(book_id, error) of books of which a chapter's summary failed: the other agents have defaults, this one fails its book."""
    return rows.filter("agent = 'chapter_summary' AND status = 'exception'").groupBy("book_id").agg(F.min_by("error", "number").alias("error"))


def listed(rows: DataFrame, order: str, name: str) -> DataFrame:
    """(book_id, name): a book's rows as an array of structs, in order."""
    fields = [c for c in rows.columns if c != "book_id"]
    each = F.collect_list(F.struct(F.col(order).alias("k"), F.struct(*fields).alias("v")))
    return rows.groupBy("book_id").agg(F.transform(F.array_sort(each), lambda x: x.v).alias(name))


def assembled(books: DataFrame, rows: DataFrame, by_chapter: DataFrame | None = None, described: DataFrame | None = None) -> DataFrame:
    """One analysis row for each book: the answers of all agents side by side, in one aggregation and one join.

    The fields of an agent without an answer are what its normal form makes of a call that failed. by_chapter has the
    normalised answers of the chapters' agents, described the image_descriptions with ord; they become arrays, empty where
    a book has none.
    """
    agents = ("genre_tags", "overview", "themes")
    answer = lambda a, c: F.max(F.when(F.col("agent") == a, F.col(c)))
    wide = rows.filter(F.col("agent").isin(*agents)).withColumn("text", F.to_json("json")).groupBy("book_id").agg(*[answer(a, c).alias(f"{a}_{c}") for a in agents for c in ("text", "status")])
    joined = books.select("book_id").join(wide, "book_id", "left")
    made: dict[str, Column] = {}
    for agent in agents:
        made |= FORMS[agent](M.parsed(F.col(f"{agent}_text")), F.coalesce(f"{agent}_status", F.lit("exception")))
    found = joined.select("book_id", *[c.alias(k) for k, c in made.items()])
    lists = []
    if by_chapter is not None:
        lists += [("technical_concepts", "ord", distinct_concepts(concept_rows(by_chapter), ["book_id"])), ("key_quotes", "ord", quotes(by_chapter)), ("chapter_summaries", "number", summaries(by_chapter))]
    if described is not None:
        lists.append(("image_descriptions", "ord", described))
    for name, order, each in lists:
        one = listed(each, order, name)
        found = found.join(one, "book_id", "left").withColumn(name, F.coalesce(name, F.array().cast(one.schema[name].dataType)))
    return found


def image_calls(images: DataFrame) -> DataFrame:
    """(book_id, ord, agent, input): three calls for each image that has bytes; the input is a data URI."""
    uri = F.concat(F.lit("data:"), F.col("content_type"), F.lit(";base64,"), F.col("base64_data"))
    agents = F.explode(F.array(*[F.lit(a) for a in IMAGE_AGENTS]))
    return images.filter(F.coalesce("base64_data", F.lit("")) != "").select("book_id", "ord", agents.alias("agent"), uri.alias("input"))


def payload(analysis: DataFrame) -> DataFrame:
    """The fields that are stored with a book; themes by their names only."""
    names = lambda c: F.transform(c, lambda x: x["name"]).alias(c)
    themes_of = ("primary_themes", "secondary_themes")
    return analysis.select(*[c for c in analysis.columns if c not in themes_of], *[names(c) for c in themes_of])


def image_descriptions(images: DataFrame, rows: DataFrame) -> DataFrame:
    """Images with description, text and class from the three calls for each; a call that failed leaves its default."""
    per = rows.groupBy("book_id", "ord").pivot("agent", list(IMAGE_AGENTS)).agg(F.first("answer"))
    return images.join(per, ["book_id", "ord"], "left").select("book_id", "ord", "filename", F.coalesce("describe", F.lit("")).alias("description"), F.coalesce(M.ocr_text(F.col("ocr")), F.lit("")).alias("ocr_text"), M.image_class(F.col("classify")).alias("image_type"), "width", "height", "page_number")
