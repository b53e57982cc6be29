"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, html_text, jaccard_join, lm_scoring, media, minhash, packing, quality, resampling, sales, secrets, sp_fst, toxicity
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return put


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the public tokenizers installed beside the libraries."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Words of every text, lower-cased A to Z, as DuckDB finds them.
_WORDS = """words AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents)"""


@query(
    "op1_minhash_near_dedup",
    f"""WITH RECURSIVE {_WORDS},
    sets AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words)),
    sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
        GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
    reach AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT reach.v, links.b FROM reach JOIN links ON links.a = reach.r)
    SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, g.component_id, g.component_id = d.doc_id AS kept
    FROM documents d JOIN (SELECT v, min(r) AS component_id FROM reach GROUP BY v) g ON g.v = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


@query("op2_secret_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    base = secrets.span_list(F.col("spans"), secrets.KINDS[:3])
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), secrets.span_list(F.col("spans")).alias("spans"))


@query("op3_quality_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query(
    "op7_chat_formatting",
    """WITH turns AS (
        SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        sum(length('### : </turn>') + 1 + length(regexp_replace(role, '([\\\\#<:])', '\\\\\\1', 'g')) + length(regexp_replace(text, '([\\\\#<])', '\\\\\\1', 'g')))::BIGINT AS formatted_chars
    FROM turns GROUP BY conv_id""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.format_conversations(turns))


@query("op8_media_columns")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.as_media(table(spark, sf_dir, "documents"))
    size = F.octet_length("payload").cast("long")
    tail = F.expr("crc32(substring(payload, octet_length(payload) - 63, 64))")
    return found.select("doc_id", "n_bytes", size.alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), tail.alias("tail_crc32"), "media_bytes", "media_sha256", "feature")


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op9_sentencepiece")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_fst.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query("op6_lm_scoring")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scored(table(spark, sf_dir, "documents"))


@query("op5_html_extraction")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query(
    "op13_sale_enrichment",
    """WITH RECURSIVE crc(i, k, c) AS (SELECT i::BIGINT, 0, i::BIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8),
    tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
    changes AS MATERIALIZED (SELECT DISTINCT * FROM client_changes WHERE valid_at IS NOT NULL),
    v AS MATERIALIZED (SELECT change_id, client_id, seq, op, valid_at, floor(100 * balance + 0.5)::BIGINT AS cents,
        least(7, floor((date_diff('day', DATE '1970-01-01', valid_at::DATE) + xor(list_reduce(list_prepend(4294967295, list_transform(string_split(change_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 4 - 19723) * 8 / 152))::BIGINT AS batch FROM changes, tab),
    s AS MATERIALIZED (SELECT sale_id, client_id, sold_at, least(7, floor((date_diff('day', DATE '1970-01-01', arrived_at::DATE) - 19723) * 8 / 152))::BIGINT AS batch FROM sales),
    ms AS (SELECT batch, max(sold_at) AS m FROM s GROUP BY batch), mv AS (SELECT batch, max(valid_at) AS m FROM v GROUP BY batch),
    marks AS MATERIALIZED (SELECT b, wc, CASE WHEN ws IS NOT NULL AND wc IS NOT NULL THEN least(ws, wc) END AS h FROM (SELECT b, (SELECT max(m) FROM ms WHERE batch < b) - INTERVAL 12 HOUR AS ws, (SELECT max(m) FROM mv WHERE batch < b) - INTERVAL 12 HOUR AS wc FROM range(9) r(b))),
    late AS (SELECT change_id, batch FROM v JOIN marks ON b = batch WHERE valid_at < wc),
    own AS MATERIALIZED (SELECT v.* FROM v JOIN marks ON b = batch WHERE (wc IS NULL OR valid_at >= wc) AND client_id IS NOT NULL),
    emitted AS MATERIALIZED (SELECT s.*, coalesce((SELECT min(b) FROM marks WHERE b >= batch AND b < 8 AND (sold_at IS NULL OR sold_at < h)), 8)::BIGINT AS at_batch FROM s),
    state AS MATERIALIZED (SELECT client_id, m.b, count(*) FILTER (batch = m.b OR p.h IS NULL OR valid_at > p.h) + max(CASE WHEN batch < m.b AND valid_at <= p.h THEN 1 ELSE 0 END) AS n_held, max(valid_at) FILTER (batch < m.b AND valid_at <= p.h) AS anchor
        FROM own JOIN marks m ON batch <= m.b LEFT JOIN marks p ON p.b = m.b - 1 GROUP BY client_id, m.b),
    last AS MATERIALIZED (SELECT client_id, valid_at, arg_max((change_id, cents, op), (seq, change_id)) AS x FROM own GROUP BY client_id, valid_at),
    sold AS (SELECT e.sale_id, e.client_id, e.sold_at, e.at_batch, l.valid_at, l.x FROM emitted e ASOF LEFT JOIN last l ON e.client_id = l.client_id AND e.sold_at >= l.valid_at)
    SELECT 'late' AS rec, change_id AS id, batch, NULL::BIGINT AS n_held, NULL::BIGINT AS change_id, NULL::BIGINT AS balance_cents, NULL::VARCHAR AS op FROM late
    UNION ALL SELECT 'sale', sale_id, at_batch, coalesce(n_held, 0)::BIGINT, CASE WHEN ok THEN x[1] END, CASE WHEN ok THEN x[2] END, CASE WHEN ok THEN x[3] END
    FROM (SELECT sold.*, state.n_held, sold.valid_at IS NOT NULL AND (state.anchor IS NULL OR sold.valid_at >= state.anchor) AS ok FROM sold LEFT JOIN state ON state.client_id = sold.client_id AND state.b = sold.at_batch)""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales.enriched(table(spark, sf_dir, "sales"), table(spark, sf_dir, "client_changes"))


@query(
    "op11_importance_resampling",
    """WITH RECURSIVE crc(i, k, c) AS (SELECT i::BIGINT, 0, i::BIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8),
    tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
    d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    own AS MATERIALIZED (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(w) AS w FROM d) GROUP BY r, w),
    goal AS MATERIALIZED (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
    vocabulary AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM own UNION SELECT w FROM goal)),
    bucket AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS b FROM vocabulary, tab),
    ss AS (SELECT b, sum(n)::BIGINT AS s FROM own JOIN bucket USING (w) GROUP BY b), tt AS (SELECT b, count(*) AS t FROM goal JOIN bucket USING (w) GROUP BY b),
    gain AS MATERIALIZED (SELECT i AS b, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM ss) + 10000)::DOUBLE) / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM tt), 0) + 10000)::DOUBLE)))::BIGINT AS g
        FROM range(10000) r(i) LEFT JOIN ss ON ss.b = i LEFT JOIN tt ON tt.b = i),
    weight AS (SELECT r, floor(sum(n * g)::DOUBLE / sum(n))::BIGINT AS weight FROM own JOIN bucket USING (w) JOIN gain USING (b) GROUP BY r),
    scored AS (SELECT d.r, doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN weight ON weight.r = d.r),
    drawn AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, n_features, r) AS rank FROM scored WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM scored WHERE n_features >= 20) // 10 THEN rank END AS rank FROM scored LEFT JOIN drawn USING (r)""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op12_jaccard_join",
    f"""WITH RECURSIVE {_WORDS},
    sets AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words)),
    sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
        GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
    reach AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT reach.v, links.b FROM reach JOIN links ON links.a = reach.r)
    SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, g.component_id
    FROM documents d JOIN (SELECT v, min(r) AS component_id FROM reach GROUP BY v) g ON g.v = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf_dir, "documents"), width=3, percent=90)
