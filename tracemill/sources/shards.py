"""Latent shards on shared storage: two tables that point at each other and lie alike.

`latents` and `metadata` are cut into directories by `shard_group` (a run of shards) and, inside these, into the same
number of files by the hash of `shard`, sorted by shard and row. Spark knows that from the catalog, so a
join on the pointer (shard_group, shard, row) moves no row of either side: the task of a bucket reads its
files of both. Directories that no metadata row points into are not read.

A log whose states point to a table of vectors can be stored as it is (`vectors` of `write_shards`): the folder holds each
vector once, in `vectors`, and `latents` holds what points to it. Readers get the same two tables; the latent is
looked up where the pointer lies.

A task holds a bucket of all directories it reads, and a directory holds one file per bucket. So for a
store of many terabytes both numbers should grow: a few thousand buckets, and groups so wide that a
file has some hundred megabytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.joins import lookup_join, small_side, sorted_before

SHARDS_PER_GROUP = 1024
POINTER = ["shard_group", "shard", "row"]
#: A bucket of metadata of at most so many rows is hashed when it is joined; larger ones are sorted, and spill.
HASHED_ROWS = 1_000_000
_LAYOUT = "buckets int, rows bigint, latents string, metadata string, vectors string, by string"


def _table_name(path: str, part: str) -> str:
    return f"tracemill_{part}_{hashlib.md5(path.encode()).hexdigest()[:16]}"


def _layout(spark: SparkSession, path: str):
    try:
        return spark.read.schema(_LAYOUT).json(f"{path}/layout").first()
    except AnalysisException:
        return None


def _attach(spark: SparkSession, path: str, part: str, columns: str, buckets: int) -> DataFrame:
    """The files as a table of the session's catalog; its partitions are looked up anew."""
    name = _table_name(path, part)
    spark.sql(f"drop table if exists {name}")
    spark.sql(
        f"create table {name} ({columns}, shard_group bigint) using parquet partitioned by (shard_group) "
        f"clustered by (shard) sorted by (shard, row) into {buckets} buckets location '{path}/{part}'"
    )
    spark.catalog.recoverPartitions(name)
    return spark.table(name)


def _store(df: DataFrame, path: str, part: str, buckets: int) -> tuple[str, int]:
    """Write one of the two tables; its columns and the number of rows."""
    seen, name = Observation(), _table_name(path, f"new_{part}")
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    writer = counted.write.partitionBy("shard_group").bucketBy(buckets, "shard").sortBy("shard", "row")
    writer.option("compression", "zstd").option("path", f"{path}/{part}").saveAsTable(name)
    df.sparkSession.sql(f"drop table {name}")  # the files stay
    return _columns(df), seen.get["rows"]


def _columns(df: DataFrame) -> str:
    return StructType([f for f in df.schema if f.name != "shard_group"]).toDDL()


def _with_vectors(spark: SparkSession, path: str, pointers: DataFrame, columns: str, by: str) -> DataFrame:
    """Pointers with the columns of the vector each leads to, in place of the pointer."""
    vectors = spark.read.schema(columns).parquet(f"{path}/vectors")
    return lookup_join(pointers, small_side(vectors), by).drop(by)


def write_shards(
    facts: DataFrame,
    path: str,
    latent: str = "latent",
    buckets: int | None = None,
    shards_per_group: int = SHARDS_PER_GROUP,
    widen: Callable[[DataFrame], DataFrame] | None = None,
    vectors: DataFrame | None = None,
    by: str = "vec_id",
) -> int:
    """Facts with shard_id, shard and row as the two tables; the number of rows. Fails when the folder holds
    shards already. Rows are shuffled once, to their bucket; `buckets` is Spark's shuffle partitions otherwise.
    `widen` is applied to rows that lie in their bucket, and should leave them there: a latent that it looks up is
    written without having been shuffled. Where facts hold a pointer `by` in place of the latent, `vectors` (of `by` and
    `latent`) is what they point to: it is stored once, and facts as they are. Facts without a vector are then left out,
    as by a join. The folder counts as written when its layout stands, which is last."""
    spark, path = facts.sparkSession, path.rstrip("/")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if _layout(spark, path) is not None:
        raise FileExistsError(f"shards in {path} already exists")
    placed = facts.withColumn("shard_group", F.expr(f"shard_id div {shards_per_group}")).drop("shard_id")
    dealt = placed.repartition(buckets, "shard")
    latents, _ = _store(widen(dealt) if widen else dealt, path, "latents", buckets)
    pointed = None
    if vectors is not None:
        vectors.write.option("compression", "zstd").parquet(f"{path}/vectors")
        pointed = _columns(vectors)
    # What was written is what is pointed at, even if the facts would come out otherwise again. It lies by
    # bucket, so nothing is shuffled.
    written = _attach(spark, path, "latents", latents, buckets)
    if pointed:
        written = _with_vectors(spark, path, written, pointed, by)
    metadata, rows = _store(written.drop(latent), path, "metadata", buckets)
    layout = spark.createDataFrame([(buckets, rows, latents, metadata, pointed, by if pointed else None)], _LAYOUT)
    layout.coalesce(1).write.mode("errorifexists").json(f"{path}/layout")
    return rows


def read_shards(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """metadata and latents as `write_shards` laid them out, attached to the session's catalog."""
    path = path.rstrip("/")
    layout = _layout(spark, path)
    if layout is None:
        raise FileNotFoundError(f"no shards in {path}")
    metadata = _attach(spark, path, "metadata", layout.metadata, layout.buckets)
    latents = _attach(spark, path, "latents", layout.latents, layout.buckets)
    hashed = layout.rows <= HASHED_ROWS * layout.buckets
    if layout.vectors:
        if not hashed:  # pointers are sorted for the join, not the latents they become
            latents = sorted_before(latents.select(*POINTER, layout.by), POINTER[:2], POINTER[2])
        latents = _with_vectors(spark, path, latents, layout.vectors, layout.by)
    columns = [c for c in latents.columns if c not in metadata.columns]  # latents hold all that was written
    if hashed:
        metadata = metadata.hint("shuffle_hash")  # of a bucket, where it lies: the wide rows need no sorting
    return metadata, latents.select(*POINTER, *columns)


def detach_shards(spark: SparkSession, path: str) -> None:
    """Take the tables out of the catalog; their files stay."""
    for part in ("metadata", "latents"):
        spark.sql(f"drop table if exists {_table_name(path.rstrip('/'), part)}")
