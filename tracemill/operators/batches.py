"""Training batches: assignment, batch maxima and padding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import as_column
from ..functions.tokens import pad_right, round_up, segments
from .numbering import RowOrder, run_places, with_position


def plan_batches(
    rows: DataFrame, id_col: str | list[str], order: RowOrder, sizes: dict[str, str], batch_rows: int
) -> DataFrame:
    """id, batch_id, batch_row and, per named array column, the longest size in the batch. Only ids
    and lengths move; a batch window holds `batch_rows` rows."""
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    narrow = rows.select(*ids, *[F.size(array).alias(name) for name, array in sizes.items()])
    placed = with_position(narrow, order, "__position")
    numbered = placed.select(
        *ids,
        F.floor(F.col("__position") / batch_rows).cast("long").alias("batch_id"),
        (F.col("__position") % batch_rows).cast("int").alias("batch_row"),
        *sizes,
    )
    batch = Window.partitionBy("batch_id")
    return numbered.select(*ids, "batch_id", "batch_row", *[F.max(n).over(batch).alias(n) for n in sizes])


def pad_batches(
    rows: DataFrame,
    id_col: str | list[str],
    order: RowOrder,
    fills: dict[str, int],
    batch_rows: int,
    multiple: int | None = None,
) -> DataFrame:
    """Right-pad each array in `fills` (column -> fill value) to its batch maximum, optionally rounded
    up to a multiple. Other columns pass through. The wide rows are shuffled once, to meet the plan. An id of
    several columns spares them that: rows that lie by one of these and are sorted by all stay where they
    are, and only the plan moves. In the order of runs (see `numbering.run_order`) whose columns are the id, the plan is a
    row per run and batch, and no row moves."""
    sizes = {f"__max_{c}": c for c in fills}
    if order.run:
        planned = _planned_in_runs(rows, id_col, order, sizes, batch_rows)
    else:
        planned = rows.join(plan_batches(rows, id_col, order, sizes, batch_rows), id_col)
    padded = {c: pad_right(c, round_up(f"__max_{c}", multiple), fill) for c, fill in fills.items()}
    return planned.withColumns(padded).drop(*sizes)


def _planned_in_runs(
    rows: DataFrame, id_col: str | list[str], order: RowOrder, sizes: dict[str, str], batch_rows: int
) -> DataFrame:
    """Rows with batch_id, batch_row and the sizes of their batch, where they lie. Rows of one id have as many places, and
    each of them meets all of these, as it does when rows and plan are joined by id."""
    if id_col != [order.run, order.row]:
        raise ValueError("in the order of runs, the id is the run and the row")
    first = F.col("__position")
    placed = run_places(rows, order, "__position")
    placed = placed.withColumn("__position", F.explode(F.sequence(first, first + F.col("__position_rows") - 1)))
    placed = placed.withColumns(
        {
            "batch_id": F.floor(first / batch_rows).cast("long"),
            "batch_row": (first % batch_rows).cast("int"),
        }
    ).drop("__position", "__position_rows")
    # A batch may begin in one run and end in another.
    largest = placed.groupBy(order.run, "batch_id").agg(*[F.max(F.size(array)).alias(name) for name, array in sizes.items()])
    batch = Window.partitionBy("batch_id")
    plan = largest.select(order.run, "batch_id", *[F.max(n).over(batch).alias(n) for n in sizes])
    return placed.join(plan.hint("shuffle_hash"), [order.run, "batch_id"])


def segment_rows(rows: DataFrame, ids: str, count) -> DataFrame:
    """One row per segment, numbered from 0."""
    kept = [c for c in rows.columns if c != ids]
    return rows.select(*kept, F.posexplode(segments(ids, as_column(count))).alias("segment_idx", ids))
