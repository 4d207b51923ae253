"""Dense positions and exact cuts in a total order, without a global sort.

Rows are assigned to buckets that are monotone in the order. Counting rows per bucket
(partial aggregation) gives the position at which each bucket starts; only rows within
one bucket then have to be ranked. Windows without partition keys appear only over the
table of counts.

Hash order (a seeded shuffle) uses leading digest digits as the bucket, at most 65,536 of
them, so buckets are uniform whatever the ids look like. Natural order leaves the buckets
to Spark: rows are range-partitioned and sorted once, written as a step, and the counts are
those of its partitions. Nothing about the keys reaches the driver. Keys must be unique, as
row positions are.

The order of runs is for rows that lie in runs already, such as shards: all rows of a run are together, and the runs
have an order of their own. Then only the counts of runs move, and rows are numbered where they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import as_column, hash_key
from ..sources.staged import stage

HASH_BUCKET_DIGITS = 4  # 16^4 buckets
_PART_BITS = 33  # of monotonically_increasing_id: the partition above, the row in it below


@dataclass(frozen=True)
class RowOrder:
    """A total order: the columns to compare and, if they have one, a bucket that is monotone in it."""

    bucket: Column | None
    keys: tuple[Column, ...]
    partitions: int | None = None
    #: In the order of runs: the column that names a row's run, the column that orders rows in it, and the order of names.
    run: str | None = None
    row: str | None = None
    run_order: Callable[[Column], Column] | None = None

    @property
    def composite(self) -> Column:
        return F.struct(*[k.alias(f"k{i}") for i, k in enumerate(self.keys)])


def shuffled_order(id_col, seed) -> RowOrder:
    """Order by a seeded digest of the id, ties by id: reproducible and partition-invariant."""
    digest = hash_key(seed, id_col)
    return RowOrder(F.substring(digest, 1, HASH_BUCKET_DIGITS), (digest, as_column(id_col)))


def natural_order(df: DataFrame, key, buckets: int | None = None) -> RowOrder:
    """Order by a key of `df` itself. `buckets` is the number of range partitions, otherwise Spark's own."""
    key = as_column(key)
    df.select(key)  # a wrong name fails here, not in a later step
    return RowOrder(None, (key,), buckets)


def run_order(run: str, row: str, order: Callable[[Column], Column]) -> RowOrder:
    """Runs by `order` of the column `run`, rows of a run by the column `row`; neither is null. Nothing is shuffled but a
    row per run where rows lie by `run`, and nothing is sorted where they are sorted by both."""
    return RowOrder(None, (order(F.col(run)), F.col(row)), None, run, row, order)


# Runs ------------------------------------------------------------------------


def run_places(df: DataFrame, order: RowOrder, output: str) -> DataFrame:
    """Append the position of the first of the rows that are equal in the order, and in `<output>_rows` how many are."""
    counts = df.groupBy(order.run).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy(order.run_order(F.col(order.run)), order.run).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(order.run, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    along = Window.partitionBy(order.run).orderBy(order.row)
    equal = F.count(F.lit(1)).over(along.rangeBetween(Window.currentRow, Window.currentRow))
    ranked = df.withColumns({output: F.rank().over(along).cast("long") - 1, f"{output}_rows": equal})
    # A row per run, hashed where the run lies: the rows stay in place and sorted.
    met = ranked.join(starts.hint("shuffle_hash"), order.run)
    return met.withColumn(output, F.col(output) + F.col("__start")).drop("__start")


# Natural order ---------------------------------------------------------------


def _placed(df: DataFrame, within: list[str], keys: list[str], partitions: int | None) -> DataFrame:
    """The rows range-partitioned and sorted, each with its partition and place in it as one number, written
    once: range bounds are sampled, so counts and rows must come from the same run."""
    wanted = [*within, *keys]
    ranged = df.repartitionByRange(partitions, *wanted) if partitions else df.repartitionByRange(*wanted)
    return stage(ranged.sortWithinPartitions(*wanted).withColumn("__at", F.monotonically_increasing_id()), "ordered")


def _starts(placed: DataFrame, within: list[str]) -> DataFrame:
    """Per partition (and value of `within`): its first place, its rows, and the rows before it. One row per
    partition, apart from further values of `within`."""
    counts = placed.groupBy(*within, F.shiftright("__at", _PART_BITS).alias("__part")).agg(
        F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n")
    )
    earlier = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("__start", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))


def range_positions(
    df: DataFrame,
    keys: list[str],
    output: str = "position",
    within: list[str] | None = None,
    partitions: int | None = None,
    total: str | None = None,
) -> DataFrame:
    """Append the 0-based position of every row in the order of `keys` (nulls first), counted anew for every
    value of `within` (null is a value), and in `total` the rows that share this value. One shuffle of
    the rows, however many share a value; rows equal in `within` and `keys` meet in one partition, in any
    order."""
    within = list(within or [])
    placed = _placed(df, within, keys, partitions)
    starts = _starts(placed, within)
    if total:
        starts = starts.withColumn(total, F.sum("__n").over(Window.partitionBy(*within)))
    named = {c: f"__w{i}" for i, c in enumerate(within)}
    starts = starts.withColumnsRenamed(named)
    # No hint: the table is one row per partition and value, and broadcast only if that is small.
    same = F.shiftright("__at", _PART_BITS) == F.col("__part")
    for column, other in named.items():
        same &= F.col(f"`{column}`").eqNullSafe(F.col(other))
    met = placed.join(starts, same)
    position = F.col("__start") + F.col("__at") - F.col("__first")
    return met.select(*[F.col(f"`{c}`") for c in df.columns], position.alias(output), *([total] if total else []))


def _range_cuts(df: DataFrame, order: RowOrder, positions: list[int]) -> list[Column]:
    names = [f"k{i}" for i in range(len(order.keys))]
    placed = _placed(df.select(order.composite.alias("k")).select("k.*"), [], names, order.partitions)
    starts = _starts(placed, [])
    cuts = []
    for p in positions:
        holds = (F.col("__start") < p) & (F.col("__start") + F.col("__n") >= p)
        place = starts.filter(holds).agg(F.max(F.col("__first") + p - 1 - F.col("__start"))).scalar()
        cuts.append(placed.filter(F.col("__at") == place).agg(F.max(F.struct(*names))).scalar())
    return cuts


# Hash order ------------------------------------------------------------------


def _bucket_ends(df: DataFrame, order: RowOrder) -> DataFrame:
    counts = df.groupBy(order.bucket.alias("__bucket")).agg(F.count(F.lit(1)).alias("__n"))
    return counts.withColumn("__end", F.sum("__n").over(Window.orderBy("__bucket")))


def with_position(df: DataFrame, order: RowOrder, output: str = "position") -> DataFrame:
    """Append the 0-based position of every row in the order (one shuffle of the rows)."""
    if order.bucket is None:
        names = [f"__k{i}" for i in range(len(order.keys))]
        keyed = df.select("*", *[k.alias(n) for n, k in zip(names, order.keys)])
        return range_positions(keyed, names, output, partitions=order.partitions).drop(*names)
    starts = _bucket_ends(df, order).select("__bucket", (F.col("__end") - F.col("__n")).alias("__start"))
    within = Window.partitionBy("__bucket").orderBy(*[f"__k{i}" for i in range(len(order.keys))])
    keyed = df.select(
        "*", order.bucket.alias("__bucket"), *[k.alias(f"__k{i}") for i, k in enumerate(order.keys)]
    )
    return (
        # The start table has one row per bucket: its size is bounded by the bucket count.
        keyed.join(F.broadcast(starts), "__bucket")
        .withColumn(output, F.col("__start") + F.row_number().over(within) - 1)
        .select(*df.columns, output)
    )


def cut_keys(df: DataFrame, order: RowOrder, positions: list[int]) -> list[Column]:
    """For each 1-based position, the composite key of the row standing there (null past the end).

    The result is a scalar subquery: a row lies among the first p rows exactly when its
    composite key is <= the p-th key, so exact-size selections need no shuffle of the rows.
    """
    if order.bucket is None:
        return _range_cuts(df, order, positions)
    ends = _bucket_ends(df, order)
    wanted = ends.select(
        "__bucket",
        (F.col("__end") - F.col("__n")).alias("__start"),
        "__end",
        F.explode(F.array(*[F.lit(p) for p in positions])).alias("__position"),
    ).filter((F.col("__position") > F.col("__start")) & (F.col("__position") <= F.col("__end")))
    keyed = df.select(order.bucket.alias("__bucket"), order.composite.alias("__key"))
    # `wanted` has at most one row per requested position.
    ranked = keyed.join(F.broadcast(wanted), "__bucket").withColumn(
        "__rank", F.row_number().over(Window.partitionBy("__bucket", "__position").orderBy("__key"))
    )
    hits = ranked.filter(F.col("__rank") == F.col("__position") - F.col("__start"))
    cuts = hits.agg(
        F.struct(
            *[F.max(F.when(F.col("__position") == p, F.col("__key"))).alias(f"p{i}") for i, p in enumerate(positions)]
        )
    ).scalar()
    return [cuts[f"p{i}"] for i in range(len(positions))]

