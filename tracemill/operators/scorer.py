"""Scorer training rows: pointer to latent, question to ids, padded per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K
from ..functions.tokens import truncate
from .batches import pad_batches
from .numbering import RowOrder
from .rollouts import resolve_latents


def question_ids(
    rows: DataFrame,
    tokenize: Callable[[Column], Column],
    questions: tuple[str, ...] = ("input", "question"),
    max_tokens: int = K.MAX_QUESTION_TOKENS,
) -> DataFrame:
    """Append input_ids of the question (the first of the `questions` columns that exists and is not null; cut to
    `max_tokens`). A question belongs to an example: tokenize the table of examples, before rollouts and states
    multiply it."""
    named = [F.col(c) for c in questions if c in rows.columns]
    return rows.withColumn("input_ids", truncate(tokenize(F.coalesce(*named, F.lit(""))), max_tokens))


def scorer_rows(
    metadata: DataFrame,
    latents: DataFrame,
    tokenize: Callable[[Column], Column] | None = None,
    questions: tuple[str, ...] = ("input", "question"),
    max_tokens: int = K.MAX_QUESTION_TOKENS,
) -> DataFrame:
    """Metadata rows with the latent they point to, input_ids of their question (see `question_ids`), timestep (0 if
    missing) and label as doubles. Without `tokenize`, the metadata must hold input_ids already."""
    timestep = F.coalesce(F.col("timestep").cast("double"), F.lit(0.0)) if "timestep" in metadata.columns else F.lit(0.0)
    # Questions become ids before the join: it is the narrow side's work.
    ready = metadata if tokenize is None else question_ids(metadata, tokenize, questions, max_tokens)
    ready = ready.withColumns({"timestep": timestep, "label": F.col("label").cast("double")})
    if "input_ids" not in ready.columns:
        raise ValueError("give a tokenizer, or metadata with input_ids")
    return resolve_latents(ready, latents)


def scorer_batches(
    rows: DataFrame, id_col: str | list[str], order: RowOrder, batch_rows: int, pad: int = 0, multiple: int | None = None
) -> DataFrame:
    """Rows in batches of `batch_rows`, their input_ids padded to the longest of the batch."""
    return pad_batches(rows, id_col, order, {"input_ids": pad}, batch_rows, multiple)
