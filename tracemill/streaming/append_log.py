"""Grading rollouts as they arrive, appended to the log.

The grading operators are row-local, so they run on a streaming DataFrame as they are; the
examples are a static table. Progress lives in the checkpoint folder, which must be on
storage all executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.rollouts import grade_against


def stream_jsonl(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int | None = None) -> DataFrame:
    """JSONL files of a folder, picked up as they land."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def append_graded(
    rollouts: DataFrame, examples: DataFrame, output: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Grade a stream of rollouts (example_id, final_text, ...) against a static table of examples
    (example_id, target) and append the graded rows as parquet."""
    writer = (
        grade_against(rollouts, examples)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
