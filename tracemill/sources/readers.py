"""Readers for JSON, JSONL, landed tables and latent shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from ..functions.answers import target_array
from ..functions.text import is_blank
from . import schemas
from .json_array import read_json_array  # noqa: F401
from .shards import read_shards  # noqa: F401  (a source like the others)


def read_table(spark: SparkSession, path: str, spread_by: str | None = None) -> DataFrame:
    """A landed parquet table. With `spread_by` (a unique key), a source of fewer partitions than the
    cluster has cores, such as one small file, is dealt out over them; larger ones are left alone."""
    df = spark.read.parquet(path)
    if spread_by:
        cores = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < cores:
            return df.repartition(cores, spread_by)
    return df


def read_landed_split(spark: SparkSession, path: str, file_format: str = "parquet", schema: StructType | str | None = None) -> DataFrame:
    """A published dataset split that already lies on shared storage."""
    reader = spark.read.format(file_format)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One record per line; blank lines are skipped, a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _located_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
    )


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_id, value for every line, blank ones included; line ids start at 0 in each file.

    A split of a file is read by one task in order, so a line's number is the number of lines in the
    file's earlier splits plus its offset within its own. Only line counts per split are aggregated;
    the table of starts, one short row per split of the input, is broadcast, so the lines themselves
    are neither sorted nor shuffled.
    """
    lines = _located_lines(spark, path)
    splits = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    return lines.join(F.broadcast(starts), ["file", "block"]).select(
        "file", (F.col("start") + F.col("id") - F.col("first_id")).alias("line_id"), "value"
    )


def read_examples(
    spark: SparkSession, path: str, schema: StructType | str, max_lines: int | None = None, id_column: str = "example_id"
) -> DataFrame:
    """JSONL records with their line number as id. Blank lines are dropped but keep their number, and
    `max_lines` counts them."""
    lines = read_numbered_lines(spark, path)
    if max_lines is not None:
        lines = lines.filter(F.col("line_id") < max_lines)
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    return lines.filter(~is_blank("value")).select(F.col("line_id").alias(id_column), parsed.alias("r")).select(
        id_column, "r.*"
    )


def read_rollout_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Rollout metadata from JSONL, `target` as an array whatever form it was written in."""
    raw = read_jsonl(spark, path, schemas.ROLLOUT_METADATA)
    return raw.withColumn("target", target_array("target"))


def read_rollout_log(spark: SparkSession, path: str) -> DataFrame:
    """The second log form from JSONL: `infer_steps` becomes is_gt and a nullable timestep."""
    raw = read_jsonl(spark, path, schemas.ROLLOUT_LOG)
    is_gt = F.col("infer_steps") == "gt"
    return raw.select(
        "input",
        "solution",
        is_gt.alias("is_gt"),
        F.when(~is_gt, F.col("infer_steps").try_cast("double")).alias("timestep"),
        "text",
        "reward",
        "lst_reward",
        F.flatten("tokens").alias("tokens"),
    )
