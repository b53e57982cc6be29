"""Sales with the client's version that was valid when they were made, as a stream in batches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import sale_state as S
from .common import fresh_path

NONE = S.NONE
RESULT = ("rec", "id", "batch", "n_held", "change_id", "balance_cents", "op")
CUT_SALES = "client long, known boolean, at long, id long, key string, span int"
CUT_CHANGES = "client long, at long, seq long, id long, op string, cents long, key string, span int"
#: What the stream needs of its state store: one that keeps maps, bounded memory, no versions beyond the last few, and stores
#: that are closed with their task, since every start opens new ones.
STREAM = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.minBatchesToRetain": "2",
}


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Session settings for as long as the block lasts."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def micros(at: Column) -> Column:
    """Microseconds since 1970 of a timestamp without a zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at.cast("timestamp_ntz"))


def batch_of(day: Column, batches: int, first: int, days: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(batches - 1), F.floor((day - first) * batches / days))).cast("int")


def heat(sales: DataFrame, changes: DataFrame, hot: int, span_rows: int) -> DataFrame:
    """(client, lo, width, n) of clients with more than `hot` rows: n spans of time, from lo on, each `width` long.

    A span is fixed for the stream; it only says which key of the state a row goes to, and no result hangs on it.
    """
    both = sales.select("client", F.nullif("at", F.lit(NONE)).alias("at")).unionByName(changes.select("client", "at")).filter("client IS NOT NULL")
    found = both.groupBy("client").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("lo"), F.max("at").alias("hi")).filter((F.col("rows") > hot) & F.col("lo").isNotNull())
    n = F.ceil(F.col("rows") / span_rows)
    return found.select("client", "lo", F.floor((F.col("hi") - F.col("lo")) / n + 1).alias("width"), n.cast("int").alias("n"))


def placed(rows: DataFrame, hot: DataFrame, slots: int) -> DataFrame:
    """Rows with the key of the state that they go to, and the span of a hot client (else -1)."""
    one = F.pmod(F.xxhash64("id"), F.col("n")).cast("int")  # a sale without a time needs no span of its own
    own = F.when(F.col("at") == NONE, one).otherwise(F.least(F.col("n") - 1, F.greatest(F.lit(0), F.floor((F.col("at") - F.col("lo")) / F.col("width")))).cast("int"))
    found = rows.join(hot, "client", "left").withColumn("span", F.when(F.col("n").isNotNull(), own).otherwise(F.lit(-1)))
    cold = F.concat(F.lit("s"), F.pmod(F.xxhash64(F.coalesce("client", "id")), F.lit(slots)).cast("string"))
    return found.withColumn("key", F.when(F.col("span") >= 0, F.concat_ws(":", F.lit("h"), F.col("client").cast("string"), F.col("span").cast("string"))).otherwise(cold)).drop("lo", "width", "n")


def heads(notes: DataFrame | None, sales: DataFrame, changes: DataFrame) -> DataFrame:
    """A tick for each span of the hot clients, with what the span can't know (see sale_state).

    notes are those of the batch before; sales and changes are this batch's, less late ones. A window holds a client's
    spans, one row each.
    """
    version, key = "struct<at: bigint, seq: bigint, id: bigint, cents: bigint, op: string>", "struct<at: bigint, seq: bigint, id: bigint>"
    nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
    own = changes.filter("span >= 0").groupBy("client", "span").agg(F.max(F.struct("at", "seq", "id", "cents", "op")).cast(version).alias("tail"), F.count(F.lit(1)).alias("n")).select("client", "span", "tail", nothing(key, "low"), "n")
    asked = sales.filter("span >= 0").select("client", "span").distinct().select("client", "span", nothing(version, "tail"), nothing(key, "low"), F.lit(0).cast("long").alias("n"))
    spans = own.unionByName(asked)
    if notes is not None:
        back = lambda c: F.coalesce(F.col(c), F.lit(NONE))
        tail = F.when(F.col("t_at").isNotNull(), F.struct(F.col("t_at").alias("at"), back("t_seq").alias("seq"), back("change_id").alias("id"), back("balance_cents").alias("cents"), F.col("op")))
        low = F.when(F.col("l_at").isNotNull(), F.struct(F.col("l_at").alias("at"), back("l_seq").alias("seq"), back("l_id").alias("id")))
        spans = spans.unionByName(notes.select("client", F.col("id").cast("int").alias("span"), tail.cast(version).alias("tail"), low.cast(key).alias("low"), F.col("n_held").alias("n")))
    merged = spans.groupBy("client", "span").agg(F.max("tail").alias("tail"), F.max("low").alias("low"), F.sum("n").alias("n"))
    client, earlier = Window.partitionBy("client"), Window.partitionBy("client").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    ticks = merged.select("client", "span", F.max("tail").over(earlier).alias("head"), F.max("low").over(client).alias("anchor"), F.sum("n").over(client).alias("n"))
    none = F.lit(NONE)
    return ticks.select(
        F.concat_ws(":", F.lit("h"), F.col("client").cast("string"), F.col("span").cast("string")).alias("key"), F.lit(S.TICK).alias("kind"), "client", F.lit(True).alias("known"),
        *[F.coalesce(f"head.{c}", none).alias(c) for c in ("at", "seq", "id")], F.col("head.op").alias("op"), F.coalesce("head.cents", none).alias("cents"), "span",
        (F.col("n") + F.col("anchor").isNotNull().cast("int")).alias("n_held"), *[F.coalesce(f"anchor.{c}", none).alias(f"a_{c}") for c in ("at", "seq", "id")],
    )


def enriched(sales: DataFrame, changes: DataFrame, batches: int = S.BATCHES, first: int = S.FIRST_DAY, days: int = S.DAYS, delay_us: int = S.DELAY_US, slot_rows: int = S.SLOT_ROWS, span_rows: int = S.SPAN_ROWS, hot_rows: int = S.HOT) -> DataFrame:
    """A row (rec 'sale') for each sale with its client's version of that time, and one (rec 'late') for each late change.

    sales has sale_id, client_id, sold_at, arrived_at; changes has change_id, client_id, seq, op, valid_at, balance. Both
    are cut into batches by day of arrival (of a change: of valid_at, plus zero to three days by its id) and fed to a
    stateful query that starts anew for each batch on one checkpoint. A table's watermark is its largest time of earlier
    batches less the delay, H the smaller of both. A change below its watermark is late; the others are one version each,
    repeated rows counted once, and rows without valid_at ignored. A sale waits until H passes sold_at, one without
    sold_at doesn't; what still waits after the last batch comes out with the number of batches as its batch.

    n_held is how many versions of the client the state held at that moment. Sales without a client have none, as have
    those of clients without changes; a version without a client serves nobody. A null arrived_at counts as the last
    batch, days before the first as the first. Equal valid_at go by seq, then change_id, nulls first. Repeated sales
    come out as often. Empty tables are empty batches. Other columns of sales aren't read; those of changes only make
    rows distinct. Times have no zone.
    """
    spark = sales.sparkSession
    home = fresh_path(spark, "sales")
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NONE))
    day = lambda c: F.floor(micros(F.col(c)) / 86_400_000_000)
    sold = sales.select(F.col("client_id").cast("long").alias("client"), F.col("client_id").isNotNull().alias("known"), F.coalesce(micros(F.col("sold_at")), F.lit(NONE)).alias("at"), number("sale_id").alias("id"), F.coalesce(batch_of(day("arrived_at"), batches, first, days), F.lit(batches - 1)).alias("batch"))
    shift = F.coalesce(F.crc32(F.col("change_id").cast("string").cast("binary")) % 4, F.lit(0))
    valid = changes.filter("valid_at IS NOT NULL").distinct().select(
        F.col("client_id").cast("long").alias("client"), micros(F.col("valid_at")).alias("at"), number("seq").alias("seq"), number("change_id").alias("id"), F.col("op").cast("string").alias("op"),
        F.coalesce(F.floor(100 * F.col("balance").cast("double") + 0.5), F.lit(NONE)).alias("cents"), batch_of(day("valid_at") + shift, batches, first, days).alias("batch"),
    )
    slots = max(1, -(-(sales.count() + changes.count()) // slot_rows))
    heat(sold, valid, hot_rows, span_rows).write.parquet(f"{home}/hot")
    hot = spark.read.schema("client long, lo long, width long, n int").parquet(f"{home}/hot")
    cut = {"sales": (sold, CUT_SALES), "changes": (valid, CUT_CHANGES)}
    for name, (rows, schema) in cut.items():
        placed(rows, hot, slots).select("batch", *[c.split()[0] for c in schema.split(", ")]).withColumn("client", F.coalesce("client", F.lit(NONE))).write.partitionBy("batch").parquet(f"{home}/{name}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(home)
    fs = path.getFileSystem(conf)
    for b in range(batches + 1):
        for name in (*cut, "ticks"):
            fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{home}/{name}/batch={b}"))  # an empty batch is one too
    times = {}
    for name, (_, schema) in cut.items():
        newest = spark.read.schema(f"{schema}, batch int").parquet(f"{home}/{name}").filter(F.col("at") != NONE).groupBy("batch").agg(F.max("at").alias("at"))
        times[name] = {r["batch"]: r["at"] for r in newest.collect()}  # a row for each batch
    any_hot = not hot.isEmpty()
    with settings(spark, STREAM):
        for b in range(batches + 1):
            marks = {name: max((at - delay_us for k, at in found.items() if k < b), default=NONE) for name, found in times.items()}
            feed(spark, home, b, marks["changes"], min(marks.values()), b == batches, slots, any_hot)
    found = spark.read.schema(S.OUTPUT).parquet(f"{home}/out").filter("rec <> 'note'")
    return found.select(*RESULT)


def feed(spark: SparkSession, home: str, b: int, late_before: int, h: int, last: bool, slots: int, any_hot: bool) -> None:
    """Start the query for one batch and wait for it to end."""
    ticks = spark.range(slots).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("key"), F.lit(S.TICK).alias("kind"), F.lit(NONE).alias("client"), F.lit(False).alias("known"), *[F.lit(NONE).alias(c) for c in ("at", "seq", "id")], F.lit(None).cast("string").alias("op"), F.lit(NONE).alias("cents"), F.lit(-1).alias("span"), F.lit(0).cast("long").alias("n_held"), *[F.lit(NONE).alias(f"a_{c}") for c in ("at", "seq", "id")])
    here = lambda name: f"{home}/{name}/batch={b}"
    on_time = F.col("at") >= late_before
    if any_hot:
        notes = spark.read.schema(S.OUTPUT).parquet(f"{home}/out").filter((F.col("rec") == "note") & (F.col("batch") == b - 1)) if b else None
        ticks = ticks.unionByName(heads(notes, spark.read.schema(CUT_SALES).parquet(here("sales")), spark.read.schema(CUT_CHANGES).parquet(here("changes")).filter(on_time)))
    ticks.write.mode("overwrite").parquet(here("ticks"))
    # as a pattern, since a restart opens the files of the batch before as well, which lie in another folder
    stream = lambda name, schema: spark.readStream.schema(schema).parquet(f"{home}/{name}/batch={{{b}}}")
    order = [c.split()[0] for c in S.INPUT.split(", ")]
    fill = lambda df, kind: df.select(*[F.col(c) if c in df.columns else F.lit(v).alias(c) for c, v in zip(order, (None, kind, NONE, True, NONE, NONE, NONE, None, NONE, -1, 0, NONE, NONE, NONE), strict=True)])
    changes = stream("changes", CUT_CHANGES)
    rows = fill(stream("sales", CUT_SALES), S.SALE).unionByName(fill(changes.filter(on_time & (F.col("client") != NONE)), S.VERSION)).unionByName(stream("ticks", S.INPUT))
    state = rows.groupBy("key").transformWithStateInPandas(S.Segments(b, h, last), S.OUTPUT, "Append", "None")
    late = changes.filter(~on_time).select(*[{"rec": F.lit("late"), "id": F.nullif("id", F.lit(NONE)), "batch": F.lit(b).cast("long"), "op": F.lit(None).cast("string")}.get(c, F.lit(None).cast("long")).alias(c) for c in (x.split()[0] for x in S.OUTPUT.split(", "))])
    query = state.unionByName(late).writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
