"""What a library answers: intents, threads, citations, chapters to read, and loans."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import CHECKOUTS
from .commits import CommitLog, Conflict, drop_all_but

LOAN_DAYS = 14
#: The words that ask for a recommendation, and the ways to name a book to talk about, tried in this order.
RECOMMEND = ("recommend", "suggest", "gimmee", "gimme", "give me", "find me", "looking for")
FOCUS = (
    r"(?:let's|lets|want to)\s+(?:talk|chat|discuss)\s+(?:about\s+)?([^\n]+)",
    r"(?:focus|switch)\s+(?:on|to)\s+([^\n]+)",
    r"tell me (?:more )?about\s+([^\n]+)",
)
#: Ordered rules: the first that matches names the intent. "my checkouts" holds the word checkout, so the first rule takes it.
INTENTS = (
    ("checkout", r"checkout|download"),
    ("return_book", r"(?s)return.*book|book.*return"),
    ("read_chapter", r"^read\s+chapter\s+\d+"),
    ("list_checkouts", r"my checkouts|my books"),
    ("help", r"help"),
    ("recommend", "|".join(RECOMMEND)),
)
#: What a reader is told when a chapter comes in parts.
PART_OF, MORE = " (Part 1 of %d)", '\n\n_Say "continue" for the next part._'
READ = r"^read\s+chapter\s+(\d+)"
RETURN = r"return\s+([^\n]+)"


def titles_asked(message: Column) -> Column:
    """Titles that a message may want to talk about, one for each way that it uses, in the order in which they are tried."""
    low = F.lower(message)
    return F.filter(F.array(*[captured(low, pattern) for pattern in FOCUS]), lambda x: x.isNotNull())


def captured(text: Column, pattern: str) -> Column:
    """The stripped first group of a pattern's first match, or null."""
    return F.when(text.rlike(pattern), T.strip(F.regexp_extract(text, pattern, 1)))


def intent(message: Column, in_book: Column, known: Callable[[Column], Column]) -> Column:
    """The intent of a message; focus_book counts only if a title in it is known, and what is left depends on the thread's mode."""
    low = F.lower(message)
    chain = None
    for name, pattern in INTENTS:
        match = low.rlike(pattern)
        chain = F.when(match, F.lit(name)) if chain is None else chain.when(match, F.lit(name))
    return chain.when(F.exists(titles_asked(message), known), F.lit("focus_book")).when(in_book, F.lit("book_question")).otherwise(F.lit("search"))


def chapter_asked(message: Column) -> Column:
    return captured(F.lower(message), READ).cast("int")


def title_asked(message: Column, known: Callable[[Column], Column]) -> Column:
    """The first title in a message that is known, or null."""
    return F.try_element_at(F.filter(titles_asked(message), known), F.lit(1))


def return_asked(message: Column) -> Column:
    """What a message wants to bring back."""
    return captured(F.lower(message), RETURN)


def last_messages(thread: DataFrame, key: str, order: str, n: int = 6) -> DataFrame:
    """The last n messages of each thread."""
    return thread.withColumn("_back", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).filter(F.col("_back") <= n).drop("_back")


def rendered(thread: DataFrame, key: str, order: str) -> DataFrame:
    """(key, history): messages as `User:` and `Assistant:` lines in order."""
    line = F.concat(F.when(F.col("role") == "user", F.lit("User: ")).otherwise(F.lit("Assistant: ")), F.col("text"))
    return thread.withColumn("_line", line).groupBy(key).agg(T.ordered_concat(F.col(order), F.col("_line"), "\n").alias("history"))


def thread_states(events: DataFrame, key: str, order: str) -> DataFrame:
    """Batch form of the thread machine: each event with mode and book after it, and messages since the last focus.

    events has focus_book (null but where a message moves the thread to a book) and leave (true where it goes back).
    """
    at = Window.partitionBy(key).orderBy(order)
    moved = F.col("focus_book").isNotNull() | F.coalesce(F.col("leave"), F.lit(False))
    step = events.withColumn("_moves", F.sum(moved.cast("int")).over(at))
    own = Window.partitionBy(key, "_moves").orderBy(order)
    return step.withColumn("book_id", F.first("focus_book").over(own)).withColumn("mode", F.when(F.col("book_id").isNotNull(), "book").otherwise("global")).withColumn("history_length", F.row_number().over(own)).drop("_moves")


def read_chapter(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, content, parts): chapters put together from their chunks in order, and cut for reading.

    Overlaps are repeated and chunks that were dropped are missing: chunks don't say where they were cut.
    """
    return chunks.groupBy(*keys).agg(T.ordered_concat(F.col("chunk_index"), F.col("content"), "\n\n").alias("content")).withColumn("parts", T.parts(F.col("content")))


def chapter_reply(chapters: DataFrame) -> DataFrame:
    """Adds `reply` and `pending`: the first part of a chapter (with parts and title) under its heading, and the parts that wait."""
    many = F.size("parts") > 1
    heading = F.concat(F.lit("*"), F.col("title"), F.lit("*"), F.when(many, F.format_string(PART_OF, F.size("parts"))).otherwise(F.lit("")), F.lit("\n\n"))
    more = F.when(many, F.lit(MORE)).otherwise(F.lit(""))
    return chapters.withColumn("reply", F.concat(heading, F.element_at("parts", 1), more)).withColumn("pending", F.when(many, F.slice(F.col("parts"), F.lit(2), F.size("parts") - 1)).otherwise(F.array().cast("array<string>")))


def continued(states: DataFrame) -> DataFrame:
    """One step of "continue": the next of the parts that wait as `reply`, null if none does, and those still waiting."""
    return states.withColumn("reply", F.try_element_at("pending", F.lit(1))).withColumn("pending", F.when(F.size("pending") > 1, F.slice(F.col("pending"), F.lit(2), F.size("pending") - 1)).otherwise(F.array().cast("array<string>")))


#: Seconds without a message after which a thread's waiting parts are gone.
PATIENCE = 3600


def reading_states(events: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """Batch form of reading on: (thread, seq, mode, book_id, history_length, source, part, waiting) after each event.

    events has (thread, seq, at, focus_book, leave, n_parts, more): n_parts says of a message that it brings a chapter in so
    many parts, more that it asks for the next part. A chapter gives its first part, and its others wait; `more` gives the
    next one, or nothing where none waits. Another chapter, a move to a book or back, and `patience` seconds without a
    message clear what waits. source is the event whose chapter the reply is from and part its number from 1, both null
    without a reply. The windows hold numbers only; texts are joined by (thread, source, part).
    """
    at = Window.partitionBy("thread").orderBy("seq")
    states = thread_states(events, "thread", "seq")
    idle = F.coalesce(F.timestamp_diff("SECOND", F.lag("at").over(at), F.col("at")) > patience, F.lit(False))
    moved = F.col("focus_book").isNotNull() | F.coalesce(F.col("leave"), F.lit(False))
    brings, asks = F.col("n_parts").isNotNull(), F.coalesce(F.col("more"), F.lit(False))
    runs = states.withColumn("_run", F.sum((idle | moved | brings).cast("int")).over(at))
    own = Window.partitionBy("thread", "_run").orderBy("seq")
    first = lambda c: F.first(c).over(own)
    asked = runs.withColumn("_source", first(F.when(F.col("n_parts").isNotNull(), F.col("seq")))).withColumn("_n", F.coalesce(first("n_parts"), F.lit(0)))
    asked = asked.withColumn("_part", 1 + F.sum((asks & ~brings).cast("int")).over(own))
    gives = (brings | asks) & (F.col("_part") <= F.col("_n"))
    waiting = F.greatest(F.col("_n") - F.col("_part"), F.lit(0)).cast("int")
    return asked.select("thread", "seq", "mode", "book_id", "history_length", F.when(gives, F.col("_source")).alias("source"), F.when(gives, F.col("_part")).cast("int").alias("part"), waiting.alias("waiting"))


def with_replies(states: DataFrame, parts: DataFrame) -> DataFrame:
    """States with `reply`, the text of their part; parts has (thread, source, part, text)."""
    return states.join(parts.withColumnRenamed("text", "reply"), ["thread", "source", "part"], "left")


def loans(checkouts: DataFrame, now: Column) -> DataFrame:
    """Loans with expiry (LOAN_DAYS after checkout if null) and whole days left, rounded down: below 0 once overdue."""
    due = F.coalesce("expiry_time", F.col("checkout_time") + F.expr(f"INTERVAL {LOAN_DAYS} DAYS"))
    left = F.floor(F.timestamp_diff("SECOND", now, F.col("expiry_time")) / 86400).cast("long")
    return checkouts.withColumn("expiry_time", due).withColumn("days_left", left)


def active(checkouts: DataFrame) -> DataFrame:
    return checkouts.filter("status = 'active'")


def auto_returned(checkouts: DataFrame, now: Column) -> DataFrame:
    """Loans with those returned that are active and past their expiry."""
    over = (F.col("status") == "active") & (F.col("expiry_time") < now)
    return checkouts.withColumn("return_time", F.when(over, now).otherwise(F.col("return_time"))).withColumn("status", F.when(over, "auto-returned").otherwise(F.col("status")))


def latest(checkouts: DataFrame, order: list[str], keys: tuple[str, ...] = ("book_id", "user_id")) -> DataFrame:
    """The last state of each book and user."""
    by = [F.col(c).desc() for c in order]
    return checkouts.withColumn("_last", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter("_last = 1").drop("_last")


class Ledger:
    """Loans as events that are only appended, each with a number; a loan's state is its last event.

    `log` lists the newest snapshot of all states and the batches of events since, so a state reads these alone. A batch
    counts once its commit is there, and its events' numbers follow from the commit's. An event that hangs on the state,
    such as a return, is checked again if another commit came first.
    """

    #: Batches after which a snapshot is taken.
    TAIL = 32
    EVENT = f"{CHECKOUTS}, at timestamp_ntz"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, f"{self.path}/log")

    def _stage(self, events: DataFrame) -> str:
        """Write a batch aside, its events in the order of `at`, then of all they say; those of a loan get ranks in the batch."""
        wanted = self.spark.createDataFrame([], self.EVENT).schema
        held = [(F.col(f.name) if f.name in events.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]
        own = Window.partitionBy("book_id", "user_id").orderBy("at", *[c for c in wanted.names if c != "at"])
        name = uuid.uuid4().hex
        events.select(*held).withColumn("place", F.row_number().over(own)).write.parquet(f"{self.path}/events/{name}")
        return name

    def _commit(self, name: str, check: Callable[[int], bool] | None = None) -> int:
        """Make a batch count, and take a snapshot if there are many; 0 if check(the version before) says no."""

        def change(number: int, held: dict) -> dict:
            if check is not None and not check(number - 1):
                raise Conflict("the state has changed")
            return {"snapshot": held.get("snapshot"), "tail": held.get("tail", {}) | {name: number}}

        number = self.log.commit(change)
        if len(self.log.state(number)["tail"]) > self.TAIL:
            self.snapshot()
        return number

    def append(self, events: DataFrame) -> int:
        """Add events (the columns of CHECKOUTS that there are, and `at`, when it happened); the number of their commit."""
        return self._commit(self._stage(events))

    def events(self, version: int | None = None) -> DataFrame:
        """The events since the newest snapshot, and its states, with `seq`: the number of each."""
        held = self.log.state(version)
        schema = f"{self.EVENT}, place long, seq long"
        parts = [self.spark.createDataFrame([], schema)]
        if held.get("snapshot"):
            parts.append(self.spark.read.schema(schema).parquet(f"{self.path}/snapshots/{held['snapshot']}"))
        if tail := held.get("tail"):
            age = F.create_map(*[x for n, v in tail.items() for x in (F.lit(n), F.lit(v))])  # TAIL entries, or a few more
            rows = self.spark.read.schema(f"{self.EVENT}, place long").parquet(*[f"{self.path}/events/{n}" for n in tail])
            number = F.element_at(age, F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)).cast("long")
            parts.append(rows.withColumn("seq", number * (1 << 32) + F.col("place")))
        return reduce(DataFrame.unionByName, parts)

    def last(self, version: int | None = None) -> DataFrame:
        """The last event of each book and user."""
        rows = self.events(version)
        fields = [c for c in rows.columns if c not in ("book_id", "user_id")]
        return rows.groupBy("book_id", "user_id").agg(F.max_by(F.struct(*fields), "seq").alias("x")).select("book_id", "user_id", "x.*")

    def snapshot(self) -> None:
        """Fold the events so far into a table of states; events that come meanwhile stay in the tail."""
        version = self.log.version()
        held, name = self.log.state(version), uuid.uuid4().hex
        self.last(version).write.parquet(f"{self.path}/snapshots/{name}")

        def change(number: int, now: dict) -> dict:
            if now["snapshot"] != held["snapshot"]:
                raise Conflict("another snapshot was first")
            return {"snapshot": name, "tail": {n: v for n, v in now["tail"].items() if n not in held["tail"]}}

        try:
            self.log.commit(change)
        except Conflict:
            return

    def check_out(self, book_id: str, user_id: str, now, source: str = "library") -> int:
        """A loan from now on, for LOAN_DAYS."""
        row = self.spark.createDataFrame([(book_id, user_id, now, "active", source, now)], "book_id string, user_id string, checkout_time timestamp_ntz, status string, source string, at timestamp_ntz")
        return self.append(row.withColumn("expiry_time", F.col("checkout_time") + F.expr(f"INTERVAL {LOAN_DAYS} DAYS")))

    def give_back(self, book_id: str, user_id: str, now) -> int:
        """Return a user's active loan of a book, and how many there were (0 or 1). Of two returns at once one finds none."""
        when = F.lit(now).cast("timestamp_ntz")
        mine = (F.col("book_id") == book_id) & (F.col("user_id") == user_id) & (F.col("status") == "active")
        active_in = lambda version: self.state(when, version).filter(mine)
        rows = active_in(self.log.version()).withColumns({"status": F.lit("returned"), "return_time": when, "at": when}).toArrow()
        if not rows.num_rows:  # the loan of one user
            return 0
        try:
            self._commit(self._stage(self.spark.createDataFrame(rows)), lambda version: not active_in(version).isEmpty())
        except Conflict:
            return 0
        return 1

    def state(self, now: Column, version: int | None = None) -> DataFrame:
        """Each book's and user's last state, loans past their expiry as returned by themselves."""
        return auto_returned(self.last(version).drop("place", "seq"), now)

    def vacuum(self, keep: int = 2) -> None:
        """Remove old commits but for the newest ones, and what only they had. Not while a write is under way."""
        found = self.log.versions()
        states = [self.log.state(v) for v in found[-keep:]]
        drop_all_but(self.spark, f"{self.path}/events", {n for s in states for n in s["tail"]})
        drop_all_but(self.spark, f"{self.path}/snapshots", {s["snapshot"] for s in states if s["snapshot"]})
        self.log.drop(found[:-keep])


def titled(checkouts: DataFrame, books: DataFrame) -> DataFrame:
    return checkouts.join(books.select("book_id", "title"), "book_id", "left").withColumn("title", F.coalesce("title", F.lit("Unknown Book")))


def with_availability(books: DataFrame, checkouts: DataFrame) -> DataFrame:
    """Books with the number of their active loans; any number of users may hold one."""
    held = active(checkouts).groupBy("book_id").agg(F.count(F.lit(1)).alias("active_loans"))
    return books.join(held, "book_id", "left").withColumn("active_loans", F.coalesce("active_loans", F.lit(0)))


def download_token(book_id: Column, user_id: Column, expiry: Column, secret: str) -> Column:
    """A token for a link that holds until `expiry`."""
    return F.sha2(F.concat_ws("|", book_id, user_id, T.short_date(expiry), F.lit(secret)), 256)


def book_overview(book: DataFrame) -> DataFrame:
    """(book_id, message): what the bot says when a thread moves to a book."""
    head = F.concat(F.lit("Now talking about "), F.col("title"), F.lit(" by "), F.array_join("authors", ", "))
    topics = F.concat(F.lit("Topics: "), F.array_join(F.slice("main_topics", 1, 5), ", "))
    return book.select("book_id", F.concat_ws("\n", head, F.nullif(F.substring("summary", 1, 150), F.lit("")), topics).alias("message"))


def chat_prompt(hits: DataFrame, history: DataFrame, question: str, key: str = "chunk_index") -> DataFrame:
    """One row with the prompt of an answer: numbered passages, the last messages, the question.

    hits are the few rows of a top-k with content; history has one row with `history`, or none.
    """
    numbered = hits.withColumn("_n", F.row_number().over(Window.orderBy(F.col("score").desc(), key)))
    both = numbered.select("_n", "content").unionByName(history.select("history"), allowMissingColumns=True)
    passage = F.when(F.col("_n").isNotNull(), F.concat(F.format_string("[%d] ", "_n"), F.col("content")))
    found = both.agg(T.ordered_concat(F.col("_n"), passage, "\n\n").alias("passages"), F.coalesce(F.max("history"), F.lit("")).alias("said"))
    return found.select(F.concat(F.lit("Passages:\n"), "passages", F.lit("\n\nEarlier:\n"), "said", F.lit("\n\nQuestion: "), F.lit(question)).alias("prompt"))


def book_detail(books: DataFrame, chapters: DataFrame, quotes: DataFrame, checkouts: DataFrame) -> DataFrame:
    """Books with their loans, their chapters (number, title, summary) in order and their quotes (ord, text, chapter).

    Each list is one aggregation by book before it is joined; a book without chapters or quotes has empty lists.
    """
    found = with_availability(books, checkouts)
    for name, rows, fields in (("chapters", chapters, ("number", "title", "summary")), ("quotes", quotes, ("ord", "text", "chapter"))):
        own = rows.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        found = found.join(own, "book_id", "left").withColumn(name, F.coalesce(name, F.array().cast(own.schema[name].dataType)))
    return found


def focused(best: DataFrame, books: DataFrame, threads: DataFrame) -> DataFrame:
    """Threads (thread, with any state) that move to the best title found: mode, book_id, empty history, and what the bot says.

    best has (thread, book_id) for threads whose question named a title well enough; the others keep mode and book, and are told so.
    """
    said = book_overview(books)
    moved = threads.join(best.select("thread", F.col("book_id").alias("found")), "thread", "left").join(said.select(F.col("book_id").alias("found"), "message"), "found", "left")
    hit = F.col("message").isNotNull()
    return moved.select(
        "thread",
        F.when(hit, F.lit("book")).otherwise(F.col("mode")).alias("mode"),
        F.when(hit, F.col("found")).otherwise(F.col("book_id")).alias("book_id"),
        F.when(hit, F.lit(0)).otherwise(F.col("history_length")).alias("history_length"),
        F.coalesce("message", F.lit("No such book was found")).alias("message"),
    )
