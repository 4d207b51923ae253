"""Evaluation reports. Each is one aggregation with map-side partials."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import constants as K
from ..functions.text import tail_lines
from ..functions.vectors import bce_with_logits, sigmoid


def scorer_metrics(scored: DataFrame, logit: str = "logit", label: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    """loss, accuracy at probability 0.5 and positive rate; 0 for an empty table."""
    y = F.col(label).cast("double")
    rows = scored.select(
        *by,
        bce_with_logits(F.col(logit), y).alias("bce"),
        ((sigmoid(logit) >= 0.5) == (y != 0)).cast("double").alias("hit"),
        y.alias("positive"),
    )
    divisor = F.greatest(F.count(F.lit(1)), F.lit(1))

    def rate(column: str):
        return F.coalesce(F.sum(column), F.lit(0.0)) / divisor

    return rows.groupBy(*by).agg(
        rate("bce").alias("loss"), rate("hit").alias("accuracy"), rate("positive").alias("positive_rate")
    )


def with_text_match(
    pairs: DataFrame, reference: str = "input", output: str = "output", tail: int | None = None, match: str = "match"
) -> DataFrame:
    """Exact text equality; with `tail`, only the last lines of the reference count."""
    wanted = F.col(reference) if tail is None else tail_lines(reference, tail)
    return pairs.withColumn(match, F.coalesce(wanted == F.col(output), F.lit(False)))


def exact_match_metrics(
    pairs: DataFrame,
    line: str = "line_id",
    match: str = "match",
    first: int = 200,
    denominator: int = K.FIRST_ROWS_DENOMINATOR,
) -> DataFrame:
    """accuracy over all rows, and hits among the first rows over a constant denominator."""
    hit = F.col(match).cast("double")
    return pairs.agg(
        F.avg(hit).alias("accuracy"),
        (F.coalesce(F.sum(F.when(F.col(line) < first, hit)), F.lit(0.0)) / denominator).alias("train_accuracy"),
    )


def evaluation_table(pairs: DataFrame, reference: str = "input", output: str = "output") -> DataFrame:
    return pairs.select(F.col(reference).alias("input"), F.col(output).alias("output"))
