"""Steps of a job written to the folder that all machines share, and read back from there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir` of the session. A session on one
    machine that names none, as in tests, gets a temporary folder; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tracemill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tracemill/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a step's rows once and read them back: it is computed once, survives lost executors, and its
    size is known to the optimizer, which broadcasts it only below `spark.sql.autoBroadcastJoinThreshold`."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_buckets(df: DataFrame, name: str, by: str, buckets: int, order: tuple[str, ...] = ()) -> DataFrame:
    """The same as files of `buckets` buckets by the hash of a column: what is read back needs no exchange to
    be grouped, windowed or joined by it. Moves no rows itself, so a task writes a file per bucket it has rows
    of, sorted by `order`. The catalog holds the table only until it is read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = f"tracemill_{path.rsplit('-', 1)[1]}"
    writer = df.write.format("parquet").bucketBy(buckets, by).option("compression", "zstd")
    if order:
        writer = writer.sortBy(*order)
    writer.option("path", path).saveAsTable(table)
    staged = spark.table(table)
    spark.sql(f"drop table {table}")  # the files stay, and `staged` names them
    return staged


def stage_dealt(df: DataFrame, name: str, by: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Rows dealt to buckets by the hash of a column, in one shuffle, a bucket per shuffle partition and a file per
    bucket. Tables staged like this by one column meet on it, and on keys that contain it, where they lie. With
    `order` a bucket is sorted once, when it is written, however often it is read (see `session.SETTINGS`)."""
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage_buckets(df.repartition(buckets, by), name, by, buckets, order)
