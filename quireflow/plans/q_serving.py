"""Queries of threads, intents and loans; orders are loans of books, and "now" is a fixed time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..operators import serving as V
from .q_chunks import CHAPTERS, RAW, fixed
from .registry import Tables, query

NOW = "1998-01-01 12:00:00"
LOANS = f"loans AS (SELECT o_orderkey, o_orderkey % 97 AS book_id, o_custkey AS user_id, o_orderdate AS checkout_time, o_orderdate + INTERVAL 14 DAYS AS expiry_time, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'returned' ELSE 'auto-returned' END AS status, TIMESTAMP '{NOW}' AS now FROM orders)"


def loans(t: Tables) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "returned").otherwise("auto-returned")
    none = F.lit(None).cast("timestamp_ntz")
    rows = t.orders.select("o_orderkey", (F.col("o_orderkey") % 97).alias("book_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("checkout_time"), none.alias("expiry_time"), state.alias("status"), none.alias("return_time"))
    return V.loans(rows, now())


def now() -> F.Column:
    return F.lit(NOW).cast("timestamp_ntz")


@query("thread_last6", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6")
def thread_last6(t: Tables) -> DataFrame:
    return V.last_messages(t.conversations, "conv_id", "turn").select("conv_id", "turn", "role")


@query("thread_render", "WITH l AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6) SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || text, chr(10) ORDER BY turn) AS history FROM l GROUP BY conv_id")
def thread_render(t: Tables) -> DataFrame:
    return V.rendered(V.last_messages(t.conversations, "conv_id", "turn"), "conv_id", "turn")


#: Utterances that the tables lack, one for each remainder of the turn; SAID_WEB in the same way for the gate.
SAID = (
    "please download it", "my checkouts", "MY BOOKS", "Return the book Dune now", "this book I return", "borrow it", "read  chapter 3", "please read chapter 3", "I need helpful things", "can you recommend one",
    "gimme some python", "Give me more", "find me a tale", "looking for the sea", "what should i read", "let''s talk about the sea", "I want to discuss the Sea", "lets chat about mud", "switch to sea stories ", "focus on mud", "tell me more about sea birds", "tell me about mud", "focus on mud, tell me about the sea", "talk about the sea",
)
SAID_WEB = ("an old tale", "the LATEST tale", "a tale of 2025", "What is a tale", "how to read", "a tutorial", "Guide me", "current tales", "today online", "trending update")


def said_sql(said: tuple[str, ...]) -> str:
    return f"CASE turn % {len(said)} " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(said)) + " END"


def said(said: tuple[str, ...]) -> F.Column:
    chain = None
    for k, x in enumerate(said):
        now, text = F.col("turn") % len(said) == k, F.lit(x.replace("''", "'"))
        chain = F.when(now, text) if chain is None else chain.when(now, text)
    return chain


#: The rules as they are stated: substrings in any order, and a title that is found counts as known if it holds "sea".
FOCUS_SQL = "list_filter([{}], lambda x: contains(x, 'sea'))".format(", ".join(f"CASE WHEN regexp_matches(low, '{p}') THEN trim(regexp_extract(low, '{p}', 1)) END" for p in (r"(?:let''s|lets|want to)\s+(?:talk|chat|discuss)\s+(?:about\s+)?([^\n]+)", r"(?:focus|switch)\s+(?:on|to)\s+([^\n]+)", r"tell me (?:more )?about\s+([^\n]+)")))


@query(
    "intent_classify",
    rf"""WITH u AS (SELECT conv_id, turn + conv_id % 24 AS turn, turn AS t, text FROM conversations), m AS (SELECT conv_id, t, CASE WHEN conv_id % 3 = 0 THEN text ELSE {said_sql(SAID)} END AS message FROM u), s AS (SELECT *, lower(message) AS low FROM m), f AS (SELECT *, {FOCUS_SQL} AS titles FROM s)
    SELECT conv_id, t AS turn, CASE WHEN contains(low, 'checkout') OR contains(low, 'download') THEN 'checkout' WHEN contains(low, 'return') AND contains(low, 'book') THEN 'return_book' WHEN regexp_matches(low, '^read\s+chapter\s+\d+') THEN 'read_chapter'
        WHEN contains(low, 'my checkouts') OR contains(low, 'my books') THEN 'list_checkouts' WHEN contains(low, 'help') THEN 'help'
        WHEN contains(low, 'recommend') OR contains(low, 'suggest') OR contains(low, 'gimmee') OR contains(low, 'gimme') OR contains(low, 'give me') OR contains(low, 'find me') OR contains(low, 'looking for') THEN 'recommend'
        WHEN len(titles) > 0 THEN 'focus_book' WHEN conv_id % 5 = 0 THEN 'book_question' ELSE 'search' END AS intent,
        TRY_CAST(nullif(regexp_extract(low, '^read\s+chapter\s+(\d+)', 1), '') AS INT) AS chapter, titles[1] AS title, CASE WHEN regexp_matches(low, 'return\s+[^\n]+') THEN trim(regexp_extract(low, 'return\s+([^\n]+)', 1)) END AS returned FROM f""",
)
def intent_classify(t: Tables) -> DataFrame:
    known = lambda title: F.contains(title, F.lit("sea"))
    shifted = t.conversations.withColumn("t", F.col("turn")).withColumn("turn", F.col("turn") + F.col("conv_id") % 24)
    message = F.when(F.col("conv_id") % 3 == 0, F.col("text")).otherwise(said(SAID))
    rows = shifted.select("conv_id", F.col("t").alias("turn"), message.alias("message"))
    return rows.select("conv_id", "turn", V.intent(F.col("message"), F.col("conv_id") % 5 == 0, known).alias("intent"), V.chapter_asked(F.col("message")).alias("chapter"), V.title_asked(F.col("message"), known).alias("title"), V.return_asked(F.col("message")).alias("returned"))


@query(
    "web_gate",
    f"""WITH m AS (SELECT conv_id, t, lower({said_sql(SAID_WEB)}) AS low, CASE WHEN conv_id % 4 <> 0 THEN (t + 3) / 10.0 END AS best FROM (SELECT conv_id, turn AS t, turn + conv_id AS turn FROM conversations))
    SELECT conv_id, t AS turn, (contains(low, 'latest') OR contains(low, 'recent') OR contains(low, 'news') OR contains(low, 'current') OR contains(low, '2024') OR contains(low, '2025') OR contains(low, 'what is') OR contains(low, 'how to') OR contains(low, 'tutorial') OR contains(low, 'guide')) OR best IS NULL OR best < 0.5 AS needs_web FROM m""",
)
def web_gate(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", F.col("turn").alias("t"), (F.col("turn") + F.col("conv_id")).alias("turn"))
    best = F.when(F.col("conv_id") % 4 != 0, (F.col("t") + 3) / 10.0)
    return rows.select("conv_id", F.col("t").alias("turn"), R.needs_web(said(SAID_WEB), best).alias("needs_web"))


@query(
    "thread_state",
    """WITH e AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN 'book' || (conv_id % 7) END AS focus, turn % 5 = 4 AS gone FROM conversations), m AS (SELECT *, sum((focus IS NOT NULL OR gone)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS mv FROM e),
    s AS (SELECT conv_id, turn, first_value(focus) OVER (PARTITION BY conv_id, mv ORDER BY turn) AS book_id, (row_number() OVER (PARTITION BY conv_id, mv ORDER BY turn))::INT AS history_length FROM m) SELECT conv_id, turn, book_id, CASE WHEN book_id IS NULL THEN 'global' ELSE 'book' END AS mode, history_length FROM s""",
)
def thread_state(t: Tables) -> DataFrame:
    events = t.conversations.select("conv_id", "turn", F.when(F.col("turn") % 4 == 1, F.concat(F.lit("book"), (F.col("conv_id") % 7).cast("string"))).alias("focus_book"), (F.col("turn") % 5 == 4).alias("leave"))
    return V.thread_states(events, "conv_id", "turn").select("conv_id", "turn", "book_id", "mode", "history_length")


@query("mention_strip", "SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS message FROM conversations")
def mention_strip(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", T.without_mention(F.concat(F.lit("<@U12AB> "), F.col("text"))).alias("message"))


@query("read_chapter", f"WITH {CHAPTERS}, {RAW}, c AS (SELECT doc_id, string_agg(content, chr(10) || chr(10) ORDER BY k) AS content FROM chunks GROUP BY doc_id) SELECT doc_id, sha256(content) AS content_sha256, CASE WHEN length(content) <= 3500 THEN 1 ELSE (length(content) - 1) // 3000 + 1 END::INT AS n_parts FROM c")
def read_chapter(t: Tables) -> DataFrame:
    found = V.read_chapter(fixed(t).withColumnRenamed("position", "chunk_index"), ["doc_id"])
    return found.select("doc_id", F.sha2("content", 256).alias("content_sha256"), F.size("parts").alias("n_parts"))


@query("checkout_active", f"WITH {LOANS} SELECT o_orderkey, book_id, user_id FROM loans WHERE status = 'active'")
def checkout_active(t: Tables) -> DataFrame:
    return V.active(loans(t)).select("o_orderkey", "book_id", "user_id")


@query("checkout_days_left", f"WITH {LOANS} SELECT o_orderkey, floor(date_diff('second', now, expiry_time) / 86400)::BIGINT AS days_left, strftime(expiry_time, '%B %d, %Y') AS due, strftime(expiry_time, '%Y-%m-%d') AS due_short, strftime(expiry_time, '%B %d') AS due_day FROM loans")
def checkout_days(t: Tables) -> DataFrame:
    due = F.col("expiry_time")
    return loans(t).select("o_orderkey", "days_left", T.long_date(due).alias("due"), T.short_date(due).alias("due_short"), T.month_day(due).alias("due_day"))


@query("checkout_auto_return", f"WITH {LOANS} SELECT o_orderkey, CASE WHEN status = 'active' AND expiry_time < now THEN 'auto-returned' ELSE status END AS status, CASE WHEN status = 'active' AND expiry_time < now THEN now END AS return_time FROM loans")
def auto_return(t: Tables) -> DataFrame:
    return V.auto_returned(loans(t), now()).select("o_orderkey", "status", "return_time")


@query("checkout_latest_state", f"WITH {LOANS} SELECT book_id, user_id, o_orderkey, status FROM loans QUALIFY row_number() OVER (PARTITION BY book_id, user_id ORDER BY checkout_time DESC, o_orderkey DESC) = 1")
def latest_state(t: Tables) -> DataFrame:
    return V.latest(loans(t), ["checkout_time", "o_orderkey"]).select("book_id", "user_id", "o_orderkey", "status")


@query("checkout_with_title", f"WITH {LOANS} SELECT l.o_orderkey, l.book_id, coalesce(p.p_name, 'Unknown Book') AS title FROM loans l LEFT JOIN part p ON p.p_partkey = l.book_id AND p.p_size < 25")
def with_title(t: Tables) -> DataFrame:
    books = t.part.filter("p_size < 25").select(F.col("p_partkey").alias("book_id"), F.col("p_name").alias("title"))
    return V.titled(loans(t), books).select("o_orderkey", "book_id", "title")


@query("book_availability", f"WITH {LOANS}, a AS (SELECT book_id, count(*) AS n FROM loans WHERE status = 'active' GROUP BY book_id) SELECT p_partkey AS book_id, coalesce(n, 0) AS active_loans FROM part LEFT JOIN a ON a.book_id = p_partkey")
def availability(t: Tables) -> DataFrame:
    return V.with_availability(t.part.select(F.col("p_partkey").alias("book_id")), loans(t))


@query("download_token", f"WITH {LOANS} SELECT o_orderkey, sha256(book_id || '|' || user_id || '|' || strftime(expiry_time, '%Y-%m-%d') || '|key') AS token FROM loans")
def token(t: Tables) -> DataFrame:
    return loans(t).select("o_orderkey", V.download_token(F.col("book_id").cast("string"), F.col("user_id").cast("string"), F.col("expiry_time"), "key").alias("token"))


@query(
    "book_detail",
    f"""WITH {LOANS}, a AS (SELECT book_id, count(*) AS n FROM loans WHERE status = 'active' GROUP BY book_id),
    c AS (SELECT p_partkey % 97 AS book_id, count(*) AS chapters, string_agg(p_partkey || ':' || p_name || ':' || p_type, '|' ORDER BY p_partkey) AS chapter_list FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1),
    q AS (SELECT s_suppkey % 97 AS book_id, string_agg(s_name, '|' ORDER BY s_suppkey) AS quote_list FROM supplier GROUP BY 1)
    SELECT b.book_id, coalesce(a.n, 0) AS active_loans, coalesce(c.chapters, 0)::INT AS n_chapters, coalesce(chapter_list, '') AS chapter_list, coalesce(quote_list, '') AS quote_list
    FROM (SELECT DISTINCT p_partkey % 120 AS book_id FROM part) b LEFT JOIN a ON a.book_id = b.book_id LEFT JOIN c ON c.book_id = b.book_id LEFT JOIN q ON q.book_id = b.book_id""",
)
def book_detail(t: Tables) -> DataFrame:
    """Parts stand for chapters with a summary, suppliers for quotes; some books have neither."""
    books = t.part.select((F.col("p_partkey") % 120).alias("book_id")).distinct()
    chapters = t.part.filter("p_partkey % 3 <> 0").select((F.col("p_partkey") % 97).alias("book_id"), F.col("p_partkey").alias("number"), F.col("p_name").alias("title"), F.col("p_type").alias("summary"))
    quotes = t.supplier.select((F.col("s_suppkey") % 97).alias("book_id"), F.col("s_suppkey").alias("ord"), F.col("s_name").alias("text"), F.lit("").alias("chapter"))
    found = V.book_detail(books, chapters, quotes, loans(t))
    line = lambda c: F.concat_ws(":", c.number.cast("string"), c.title, c.summary)
    return found.select("book_id", "active_loans", F.size("chapters").alias("n_chapters"), F.array_join(F.transform("chapters", line), "|").alias("chapter_list"), F.array_join(F.transform("quotes", lambda q: q.text), "|").alias("quote_list"))


@query(
    "read_chapter_reply",
    f"""WITH {CHAPTERS}, {RAW}, c AS (SELECT doc_id, string_agg(content, chr(10) || chr(10) ORDER BY k) AS content FROM chunks GROUP BY doc_id), n AS (SELECT *, CASE WHEN length(content) <= 3500 THEN 1 ELSE (length(content) - 1) // 3000 + 1 END AS parts FROM c)
    SELECT doc_id, sha256('*Doc ' || doc_id || '*' || CASE WHEN parts > 1 THEN ' (Part 1 of ' || parts || ')' ELSE '' END || chr(10) || chr(10) || CASE WHEN parts > 1 THEN content[1:3000] || chr(10) || chr(10) || '_Say "continue" for the next part._' ELSE content END) AS reply_sha256, (parts - 1)::INT AS waiting,
        CASE WHEN parts > 1 THEN sha256(content[3001:6000]) END AS next_sha256, greatest(parts - 2, 0)::INT AS still_waiting FROM n""",
)
def read_chapter_reply(t: Tables) -> DataFrame:
    """What a reader gets of each chapter, what waits, and what "continue" gives then."""
    found = V.read_chapter(fixed(t).withColumnRenamed("position", "chunk_index"), ["doc_id"])
    first = V.chapter_reply(found.withColumn("title", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")))).select("doc_id", F.sha2("reply", 256).alias("reply_sha256"), F.size("pending").alias("waiting"), "pending")
    return V.continued(first).select("doc_id", "reply_sha256", "waiting", F.sha2("reply", 256).alias("next_sha256"), F.size("pending").alias("still_waiting"))


READING = """e AS (SELECT conv_id AS thread, turn AS seq, turn * 600 + CASE WHEN turn > 6 THEN 7200 ELSE 0 END AS sec, CASE WHEN turn % 7 = 5 AND conv_id % 3 = 0 THEN 'b' || conv_id END AS focus_book, turn % 7 = 6 AND conv_id % 3 = 1 AS leave,
        CASE WHEN turn % 7 IN (0, 4) THEN greatest(1, (length(text) + 39) // 40)::INT END AS n_parts, turn % 7 IN (1, 2, 3, 5, 6) AS more, text FROM conversations),
    m AS (SELECT *, focus_book IS NOT NULL OR leave AS moved, coalesce(sec - lag(sec) OVER w > 3600, false) AS idle FROM e WINDOW w AS (PARTITION BY thread ORDER BY seq)),
    r AS (SELECT *, sum((idle OR moved OR n_parts IS NOT NULL)::INT) OVER w AS run, sum(moved::INT) OVER w AS book_run FROM m WINDOW w AS (PARTITION BY thread ORDER BY seq)),
    p AS (SELECT *, first(focus_book) OVER b AS book_id, row_number() OVER b AS history_length, first(n_parts) OVER o AS n, first(text) OVER o AS source, 1 + sum((more AND n_parts IS NULL)::INT) OVER o AS part FROM r WINDOW b AS (PARTITION BY thread, book_run ORDER BY seq), o AS (PARTITION BY thread, run ORDER BY seq))
    SELECT thread, seq, CASE WHEN book_id IS NULL THEN 'global' ELSE 'book' END AS mode, book_id, history_length::INT AS history_length, CASE WHEN (more OR n_parts IS NOT NULL) AND part <= n THEN source[(40 * (part - 1) + 1)::BIGINT:(40 * part)::BIGINT] END AS reply, greatest(coalesce(n, 0) - part, 0)::INT AS waiting FROM p"""


def reading_events(t: Tables) -> DataFrame:
    """Conversations as threads that read: some turns bring a chapter in parts of 40 characters, some ask for more, some move."""
    turn, other = F.col("turn") % 7, F.col("conv_id") % 3
    n = F.greatest(F.lit(1), F.floor((F.length("text") + 39) / 40)).cast("int")
    parts = F.when(turn.isin(0, 4), F.transform(F.sequence(F.lit(1), n), lambda k: F.substring(F.col("text"), 40 * (k - 1) + 1, F.lit(40))))
    seconds = F.col("turn") * 600 + F.when(F.col("turn") > 6, 7200).otherwise(0)
    return t.conversations.select(
        F.col("conv_id").cast("string").alias("thread"), F.col("turn").cast("long").alias("seq"), F.timestamp_seconds(1_704_067_200 + seconds).alias("at"),
        F.when((turn == 5) & (other == 0), F.concat(F.lit("b"), F.col("conv_id").cast("string"))).alias("focus_book"), ((turn == 6) & (other == 1)).alias("leave"), parts.alias("parts"), turn.isin(1, 2, 3, 5, 6).alias("more"),
    )


@query("thread_reading", f"WITH {READING}")
def thread_reading(t: Tables) -> DataFrame:
    """What every thread gets to read, and how many parts wait, after each message."""
    events = reading_events(t)
    parts = events.filter("parts IS NOT NULL").select("thread", F.col("seq").alias("source"), F.posexplode("parts").alias("part", "text")).withColumn("part", F.col("part") + 1)
    states = V.reading_states(events.withColumn("n_parts", F.size(F.col("parts"))).withColumn("n_parts", F.when(F.col("parts").isNotNull(), F.col("n_parts"))).drop("parts"))
    return V.with_replies(states, parts).select(F.col("thread").cast("long").alias("thread"), "seq", "mode", "book_id", "history_length", "reply", "waiting")


@query("thread_reading_stream", f"WITH {READING}")
def thread_reading_stream(t: Tables) -> DataFrame:
    """The same through the stateful stream, fed in two batches of turns that run on one checkpoint."""
    from ..staging import fresh_path
    from ..streaming.run import ROCKSDB, append_all, settings
    from ..streaming.threads import READING as SCHEMA
    from ..streaming.threads import reading_stream

    home = fresh_path(t.spark, "threads")
    events = reading_events(t)
    with settings(t.spark, ROCKSDB):
        for part in (events.filter("seq < 3"), events.filter("seq >= 3")):
            part.write.mode("append").parquet(f"{home}/events")
            append_all(reading_stream(t.spark.readStream.schema(events.schema).parquet(f"{home}/events"), late="30 days"), home)
    return t.spark.read.schema(SCHEMA).parquet(f"{home}/out").withColumn("thread", F.col("thread").cast("long"))


@query("chat_events_stream", "SELECT (row_number() OVER (ORDER BY turn % 2, turn, conv_id::VARCHAR, role, text) - 1)::BIGINT AS seq, conv_id AS thread, turn, role, text FROM conversations")
def chat_events_stream(t: Tables) -> DataFrame:
    """Conversations through the chat source: even turns are published and read, then odd ones, from one checkpoint."""
    from ..staging import fresh_path
    from ..streaming.chat_source import SCHEMA, chat_events, publish
    from ..streaming.run import append_all

    home = fresh_path(t.spark, "chat")
    events = t.conversations.withColumnRenamed("conv_id", "thread")
    for rest in (0, 1):
        publish(events.filter(F.col("turn") % 2 == rest), f"{home}/log", 10_000)
        append_all(chat_events(t.spark, f"{home}/log"), home)
    return t.spark.read.schema(SCHEMA).parquet(f"{home}/out").withColumn("thread", F.col("thread").cast("long"))


@query(
    "ledger_state",
    f"""WITH {LOANS}, a AS (SELECT book_id, user_id, 0 AS part, checkout_time AS tm, status FROM loans WHERE o_orderkey % 2 = 0 UNION ALL SELECT book_id, user_id, 1, checkout_time, 'active' FROM loans WHERE o_orderkey % 2 = 1),
    last AS (SELECT book_id::VARCHAR AS book_id, user_id::VARCHAR AS user_id, arg_max((status, tm), (part, tm, CASE status WHEN 'active' THEN 0 WHEN 'auto-returned' THEN 1 ELSE 2 END)) AS x FROM a GROUP BY book_id, user_id)
    SELECT book_id, user_id, CASE WHEN x[1] = 'active' AND x[2] + INTERVAL 14 DAYS < TIMESTAMP '{NOW}' THEN 'auto-returned' ELSE x[1] END AS status, CASE WHEN x[1] = 'active' AND x[2] + INTERVAL 14 DAYS < TIMESTAMP '{NOW}' THEN TIMESTAMP '{NOW}' END AS return_time FROM last""",
)
def ledger_state(t: Tables) -> DataFrame:
    """The state of a ledger after two batches of events with a snapshot in between: a loan's last event counts."""
    from ..staging import fresh_path

    ledger = V.Ledger(t.spark, fresh_path(t.spark, "ledger"))
    own = loans(t).select("o_orderkey", F.col("book_id").cast("string").alias("book_id"), F.col("user_id").cast("string").alias("user_id"), "checkout_time", "expiry_time", "status", F.col("checkout_time").alias("at"))
    ledger.append(own.filter("o_orderkey % 2 = 0"))
    ledger.snapshot()
    ledger.append(own.filter("o_orderkey % 2 = 1").withColumn("status", F.lit("active")))
    return ledger.state(now()).select("book_id", "user_id", "status", "return_time")


@query(
    "chat_with_book",
    "WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), p AS (SELECT *, vec_id = min(vec_id) OVER (PARTITION BY label) AS is_metadata FROM embeddings), h AS (SELECT e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM p e, q WHERE e.label = 3 AND NOT e.is_metadata ORDER BY score DESC, e.vec_id LIMIT 5), n AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS n FROM h), "
    "t AS (SELECT * FROM conversations WHERE conv_id = 1 QUALIFY row_number() OVER (ORDER BY turn DESC) <= 6), s AS (SELECT string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || text, chr(10) ORDER BY turn) AS history FROM t) "
    "SELECT 'Passages:' || chr(10) || (SELECT string_agg('[' || n || '] passage ' || vec_id, chr(10) || chr(10) ORDER BY n) FROM n) || chr(10) || chr(10) || 'Earlier:' || chr(10) || coalesce((SELECT history FROM s), '') || chr(10) || chr(10) || 'Question: why?' AS prompt",
)
def chat_with_book(t: Tables) -> DataFrame:
    from .q_retrieval import asked, points

    hits = R.top_k(R.chunks_only(points(t)), asked(t), 5, {"label": 3}, "vec_id").withColumn("content", F.concat(F.lit("passage "), F.col("vec_id").cast("string")))
    thread = V.last_messages(t.conversations.filter("conv_id = 1"), "conv_id", "turn")
    return V.chat_prompt(hits, V.rendered(thread, "conv_id", "turn"), "why?", "vec_id")


@query("focus_book", "SELECT p_partkey AS book_id, 'Now talking about ' || p_name || ' by ' || p_brand || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_type || chr(10) END || 'Topics: ' || array_to_string(string_split(p_name, ' ')[1:5], ', ') AS message FROM part")
def focus_book(t: Tables) -> DataFrame:
    books = t.part.select(F.col("p_partkey").alias("book_id"), F.col("p_name").alias("title"), F.array("p_brand").alias("authors"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise(F.col("p_type")).alias("summary"), F.split("p_name", " ").alias("main_topics"))
    return V.book_overview(books)


@query("list_books", f"WITH {LOANS}, a AS (SELECT book_id, count(*) AS n FROM loans WHERE status = 'active' GROUP BY book_id) SELECT p_partkey AS book_id, p_name AS title, coalesce(n, 0) AS active_loans FROM part LEFT JOIN a ON a.book_id = p_partkey WHERE p_size IN (1, 2, 3) ORDER BY p_name, p_partkey LIMIT 10 OFFSET 10")
def list_books(t: Tables) -> DataFrame:
    """The second page of books that match a filter, by title, with their loans; the page is cut before the join."""
    from ..functions.filters import matching

    books = matching(t.part, {"p_size": [1, 2, 3]}).select(F.col("p_partkey").alias("book_id"), F.col("p_name").alias("title"))
    return V.with_availability(R.page(books, 2, 10), loans(t))


@query(
    "focus_thread",
    """WITH b AS (SELECT DISTINCT conv_id AS thread FROM conversations), f AS (SELECT thread, CASE WHEN thread % 3 = 0 THEN thread % 50 + 1 END AS found FROM b), p AS (SELECT p_partkey, 'Now talking about ' || p_name || ' by ' || p_brand || chr(10) || p_type || chr(10) || 'Topics: ' || p_name AS message FROM part)
    SELECT thread, CASE WHEN message IS NOT NULL OR thread % 2 = 0 THEN 'book' ELSE 'global' END AS mode, CASE WHEN message IS NOT NULL THEN found WHEN thread % 2 = 0 THEN 7 END AS book_id, CASE WHEN message IS NOT NULL THEN 0 ELSE 4 END AS history_length, coalesce(message, 'No such book was found') AS message FROM f LEFT JOIN p ON p_partkey = found""",
)
def focus_thread(t: Tables) -> DataFrame:
    """Threads that ask for a title: those whose title is found move to its book, the others stay where they are."""
    threads = t.conversations.select(F.col("conv_id").alias("thread")).distinct()
    best = threads.filter("thread % 3 = 0").select("thread", (F.col("thread") % 50 + 1).alias("book_id"))
    own = F.col("thread") % 2 == 0
    states = threads.select("thread", F.when(own, "book").otherwise("global").alias("mode"), F.when(own, F.lit(7).cast("long")).alias("book_id"), F.lit(4).alias("history_length"))
    books = t.part.select(F.col("p_partkey").alias("book_id"), F.col("p_name").alias("title"), F.array("p_brand").alias("authors"), F.col("p_type").alias("summary"), F.array("p_name").alias("main_topics"))
    return V.focused(best, books, states)
