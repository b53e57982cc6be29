"""Ingest in batches that can be resumed: what is left to do, progress, and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import staged


def remaining(files: DataFrame, progress: DataFrame, max_files: int = 0, retry_failed: bool = False) -> DataFrame:
    """Files not yet done, in the order of their lower-cased names.

    max_files limits the list before what is done is taken from it. Failed files count as done, unless they are to be retried.
    """
    first = files.orderBy(F.lower("file_name"), "path").limit(max_files) if max_files else files
    done = progress.filter("status <> 'failed'") if retry_failed else progress
    return first.join(done.select("path").distinct(), "path", "left_anti")


def counters(progress: DataFrame, keys: list[str] | None = None) -> DataFrame:
    failed = F.col("status") == "failed"
    return progress.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("processed_files"), F.count_if(~failed).alias("successful_files"), F.count_if(failed).alias("failed_files"))


def with_rates(counts: DataFrame, total: Column, elapsed_s: Column) -> DataFrame:
    """Percent done, files a minute and minutes to go; 0 where nothing is known yet."""
    rate = F.when(elapsed_s > 0, F.col("processed_files") / elapsed_s * 60).otherwise(0.0)
    return counts.withColumn("percent", F.when(total > 0, F.col("processed_files") * 100.0 / total).otherwise(0.0)).withColumn("files_per_minute", rate).withColumn("eta_minutes", F.when(rate > 0, (total - F.col("processed_files")) / rate).otherwise(0.0))


def errors(progress: DataFrame) -> DataFrame:
    """(path, error) of failed files."""
    return progress.filter("status = 'failed'").select("path", "error")


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with their place in an order, from 1, where no task holds more than its range of it.

    Rows are dealt into ranges of the whole order, sorted there and written down; what comes before a range is the sum of the
    sizes of those before it, a number for each range. As the order may have many columns, rows that agree in the first ones
    still fall into many ranges; only rows that agree in all of it stay together.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    held = staged(dealt.withColumn("_range", F.spark_partition_id()).withColumn("_own", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1), "places")
    before, total = [], 0
    for r in held.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).orderBy("_range").collect():  # a row for each range
        before.append((r["_range"], total))
        total += r["n"]
    starts = spark.createDataFrame(before, "_range int, _before long")
    return held.join(F.broadcast(starts), "_range").withColumn("place", F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")


def numbered(files: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """Files with their place in the order of discovery, from 1: lower-cased name, then path, nulls last, then the columns of ties.

    Many files may have one name; without ties, the order of rows that share a path too is open.
    """
    return placed(files, [F.lower("file_name").asc_nulls_last(), F.col("path").asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties]])


def positions(files: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """Files with their mark [i/n] in the order of discovery."""
    found = numbered(files, ties)
    return found.withColumn("mark", F.format_string("[%d/%d]", "place", F.lit(found.count()))).drop("place")


def summary(progress: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Totals, seconds from the first to the last file, and the sorted names of files that failed."""
    failed = F.col("status") == "failed"
    name = F.element_at(F.split("path", "/"), -1)
    return progress.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("total"), F.count_if(~failed).alias("successful"), F.count_if(failed).alias("failed"), F.timestamp_diff("SECOND", F.min("at"), F.max("at")).alias("seconds"), F.array_sort(F.collect_list(F.when(failed, name))).alias("failed_files"))


def exit_code(failed: int, interrupted: bool = False) -> int:
    return 130 if interrupted else int(failed > 0)
