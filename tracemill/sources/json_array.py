"""A JSON array in one file, read by as many tasks as the file has splits.

The text reader cuts a file at every closing brace, whichever split it lies in. What a piece means depends on where it
starts: inside a string or not, and how deep. Whether a quote opens or closes a string does not matter for their
number, so the state at a piece is the count of quotes before it, modulo two; each piece knows what it adds to the
depth under either state; and a record ends at a brace that brings the depth back to one. All three
are sums over earlier pieces: within a split by a window, over splits by a table of one row per split. Only then
do pieces meet by record, and records of any number spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from .staged import stage

_BRACE = "}"


def _without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Text up to each closing brace (or the end), its quotes, and what it adds to the depth before that brace
    if it starts outside and if it starts inside a string."""
    raw = spark.read.option("lineSep", _BRACE).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        "value",
    )
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # without what is escaped
    string = r'"[^"]*(?:"|\z)'
    outside = F.regexp_replace(plain, string, "")
    inside = F.regexp_replace(F.regexp_replace(plain, r'\A[^"]*(?:"|\z)', ""), string, "")
    deeper = lambda text: _without(text, "{[") - _without(text, "]")
    return raw.select(
        "*", _without(plain, '"').alias("quotes"), deeper(outside).alias("outside"), deeper(inside).alias("inside")
    )


def _with_sum_before(rows: DataFrame, column: str, output: str) -> DataFrame:
    """Append the sum of a column over the file's earlier pieces. The table of splits, one short row per split of
    the input, is broadcast; pieces stay in their split."""
    splits = rows.groupBy("file", "block").agg(F.sum(column).alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__start"))
    before = Window.partitionBy("file", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    met = rows.join(F.broadcast(starts), ["file", "block"])
    return met.withColumn(output, F.col("__start") + F.coalesce(F.sum(column).over(before), F.lit(0))).drop("__start")


def _must(condition: Column, message: str) -> Column:
    """True, or the end of the job."""
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit(message + " in "), F.col("file"))).cast("boolean")
    )


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Pieces with their record's number in the file; `last` marks what follows a file's last brace."""
    pieces = stage(_pieces(spark, path), "json-pieces")
    starts = pieces.groupBy("file").agg(F.min_by("value", F.struct("block", "id")).alias("value"))
    bad = starts.filter(~F.col("value").rlike(r"\A\s*\[")).select("file").first()
    if bad:
        raise ValueError(f"expected {bad[0]} to contain a JSON list")
    ends = pieces.groupBy("file").agg(F.max(F.struct("block", "id")).alias("end"))  # a row per file
    rows = pieces.join(F.broadcast(ends), "file").withColumn("last", F.col("end") == F.struct("block", "id")).drop("end")
    rows = _with_sum_before(rows, "quotes", "before")
    closed = (F.col("before") + F.col("quotes")) % 2 == 0
    brace = F.when(closed & ~F.col("last"), F.lit(1)).otherwise(F.lit(0))
    rows = rows.withColumn("delta", F.when(F.col("before") % 2 == 0, F.col("outside")).otherwise(F.col("inside")) - brace)
    rows = _with_sum_before(rows, "delta", "depth")
    depth = F.col("depth") + F.col("delta")
    ends_record = closed & ~F.col("last") & (depth == 1)
    rows = rows.withColumn("ends", F.when(ends_record, F.lit(1)).otherwise(F.lit(0)))
    return _with_sum_before(rows.withColumn("left", F.when(closed, depth)), "ends", "record")


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files that each hold one JSON array of objects. A file whose top level is anything else fails here, one
    that breaks off or holds other elements fails the job that reads it."""
    rows = _placed(spark, path)
    empty = F.col("value").rlike(r"\A\s*\[\s*\]\s*\z") & (F.col("record") == 0)
    finished = F.col("value").rlike(r"\A\s*\]\s*\z") & (F.col("record") > 0) & (F.col("left") == 0)
    tail = rows.filter("last").filter(~_must(empty | finished, "expected a JSON list"))  # leaves no row
    whole = rows.filter("not last").groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("block", "id", "value"))).alias("pieces"), F.max("ends").alias("ends")
    )
    text = F.concat(F.array_join(F.transform("pieces", lambda p: p["value"]), _BRACE), F.lit(_BRACE))
    whole = whole.select("file", "record", "ends", text.alias("text"))
    lead = F.when(F.col("record") == 0, F.lit(r"\A\s*\[\s*(?=\{)")).otherwise(F.lit(r"\A\s*,\s*(?=\{)"))
    fits = _must((F.col("ends") == 1) & F.regexp_like("text", lead), "expected a JSON list of objects")
    parsed = F.from_json(F.regexp_replace("text", lead, F.lit("")), schema, {"mode": "FAILFAST"})
    records = whole.filter(fits).select(parsed.alias("r")).select("r.*")
    return records.unionByName(tail.select(F.from_json(F.lit("{}"), schema).alias("r")).select("r.*"))
