"""Tables that are written between the steps of a job, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes in an Arrow batch: texts are unbounded, so a worker gets few of them at once.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own, and a cluster an error."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if held:
        return held.rstrip("/")
    context = spark.sparkContext
    own = context._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="quireflow-"))
    return context._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: it is computed once, and a lost executor loses nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts short. It stays so for the session, as results are read lazily."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def files_of(spark: SparkSession, path: str) -> tuple[object, type]:
    """Hadoop's file system of a path, and its class of paths."""
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, on the driver."""
    return spark.read.text(path, wholetext=True).first()[0]


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file under a name that must be free; False if another writer was first.

    It is written aside and renamed, so nobody sees half of it; file systems of a cluster refuse to rename onto a file
    that is there. A local one doesn't, so there the name itself is taken by an exclusive create before.
    """
    fs, make = files_of(spark, path)
    jvm = spark.sparkContext._jvm
    if fs.getScheme() == "file":
        name = jvm.java.nio.file.Paths.get(make(path).toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.String, 0))
        aside = jvm.java.nio.file.Paths.get(f"{make(path).toUri().getPath()}.{uuid.uuid4().hex}", spark.sparkContext._gateway.new_array(jvm.String, 0))
        none = spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0)
        jvm.java.nio.file.Files.createDirectories(name.getParent(), none)
        jvm.java.nio.file.Files.writeString(aside, text, spark.sparkContext._gateway.new_array(jvm.java.nio.file.OpenOption, 0))
        try:
            jvm.java.nio.file.Files.createLink(name, aside)  # fails if the name is taken
            return True
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            return False
        finally:
            jvm.java.nio.file.Files.deleteIfExists(aside)
    aside = f"{path}.{uuid.uuid4().hex}"
    out = fs.create(make(aside), False)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.exists(make(path)) and fs.rename(make(aside), make(path)):
        return True
    fs.delete(make(aside), False)
    return False
