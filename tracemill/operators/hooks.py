"""Places where a user's own callable joins a Spark job.

Callables see Arrow batches, never single rows, and heavy objects are built once per
Python worker task through a factory.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat
from keyword import iskeyword

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import Row, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn

from ..functions.text import as_column


def map_rows(df: DataFrame, function: Callable[..., dict], schema: StructType | str, **kwargs) -> DataFrame:
    """A function from one record (a dict) to one record, for logic no expression covers."""

    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Arrow keeps integers and nulls as they are; pandas would turn both into floats.
            yield pa.RecordBatch.from_pylist([function(r, **kwargs) for r in batch.to_pylist()], schema=arrow)

    return df.mapInArrow(run, kind)


def map_batches(
    df: DataFrame,
    function: Callable[..., pd.DataFrame],
    schema: StructType | str,
    batch_rows: int = 64,
    **kwargs,
) -> DataFrame:
    """A function from a pandas batch of at most `batch_rows` rows to a pandas batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), batch_rows):
                yield function(batch.iloc[start : start + batch_rows].reset_index(drop=True), **kwargs)

    return df.mapInPandas(run, schema)


def tokenize(text, factory: Callable[[], Callable[[list[str]], Iterable[list[int]]]], most_chars: int = 1 << 20) -> Column:
    """Token ids from a user tokenizer. `factory` returns a callable from texts to id lists. It is given a few texts at
    a time, up to `most_chars` characters (or one longer text), and their ids are packed before the next ones:
    Python lists of ids take many times the bytes of the texts."""
    kind = pa.list_(pa.int32())

    def slices(texts: pa.Array) -> Iterator[list[str]]:
        part, chars = [], 0
        for one in texts:
            value = one.as_py()
            if part and chars + len(value or "") > most_chars:
                yield part
                part, chars = [], 0
            part.append(value)
            chars += len(value or "")
        if part:
            yield part

    @arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = factory()
        for texts in batches:
            packed = [pa.array([None if r is None else list(r) for r in tokenizer(part)], kind) for part in slices(texts)]
            yield pa.concat_arrays(packed) if packed else pa.array([], kind)

    return ids(as_column(text))


def run_model(
    df: DataFrame,
    factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
    schema: StructType | str,
    batch_rows: int = 64,
) -> DataFrame:
    """Batch inference with a user model: text -> latent (encoder) or latent -> text (decoder).
    `factory` loads the model once per task and returns a callable on pandas batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            for start in range(0, len(batch), batch_rows):
                yield model(batch.iloc[start : start + batch_rows].reset_index(drop=True))

    return df.mapInPandas(run, schema)


def reward(
    ids, latent, factory: Callable[[], Callable[[pd.Series, pd.Series, pd.Series], Iterable[float]]], timestep=None
) -> Column:
    """Scores from a user model on (question ids, latent, timestep); a missing timestep means 0."""

    @pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer = factory()
        for question, state, t in batches:
            yield pd.Series(list(scorer(question, state, t)), dtype="float64")

    t = F.lit(0.0) if timestep is None else F.coalesce(as_column(timestep).cast("double"), F.lit(0.0))
    return score(as_column(ids), as_column(latent), t)


def generate_rollouts(examples: DataFrame, generator, *columns: str) -> DataFrame:
    """One-to-many generation: apply a table function (made with pyspark's `udtf`) to each example.
    The examples' columns are repeated beside the generated ones."""
    return examples.lateralJoin(generator(*[F.col(c).outer() for c in columns]))


_CHUNK, _ROWS = "__chunk", "__rows"


def pack_rows(
    df: DataFrame,
    keys: tuple[str, ...] = ("example_id",),
    order: tuple[str, ...] = ("rollout_id", "step_id"),
    needs: tuple[str, ...] = (),
    most: int = 1024,
) -> DataFrame:
    """The rows of an example, in the given order, as few rows of up to `most` each: an array per column. A table
    function of `generator_per_example` that is given these spends its cost per row on a whole array. Rows that
    lie by the keys are not shuffled; an example of any length becomes as many rows as it needs."""
    packed = [c for c in dict.fromkeys((*order, *needs)) if c not in keys]
    if not packed:
        raise ValueError("there are no columns to pack")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    placed = df.select(*keys, *packed).withColumn("__place", place)
    # Places are unique in an example, so sorting compares nothing else.
    lists = F.sort_array(F.collect_list(F.struct("__place", *packed)))
    grouped = placed.groupBy(*keys, F.floor(F.col("__place") / most).alias(_CHUNK)).agg(lists.alias(_ROWS))
    return grouped.select(*keys, _CHUNK, *[F.col(_ROWS)[c].alias(c) for c in packed])


def _record(names: list[str]) -> Callable:
    """From values to a row with these names: a named tuple, or a Row if a name can't be an attribute."""
    plain = all(n.isidentifier() and not iskeyword(n) and not n.startswith("_") for n in names)
    if plain:
        return namedtuple("Record", names)._make
    made = Row(*names)
    return lambda values: made(*values)


def generator_per_example(
    factory: Callable[[], object],
    schema: StructType | str,
    keys: tuple[str, ...] = ("example_id",),
    order: tuple[str, ...] = ("rollout_id", "step_id"),
    needs: tuple[str, ...] = (),
):
    """A table function over all rows of an example: call it with `df.asTable()`.

    Spark sends the rows of one example, by `keys`, to one generator in the given order; an example of any length
    passes by row by row, and only what the generator keeps is held. `factory` makes a generator per example:
    `add(row)` and `finish()` return the rows to emit, as tuples of `schema`. A table without one of the
    columns is refused when the query is analysed, and columns that are not named are not sent.

    A row sent to Python costs tens of microseconds. Of a table made by `pack_rows` with the same columns, Spark sends
    an array of rows at a time, and the generator still gets them one by one, as named tuples."""
    result = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    named = [*dict.fromkeys((*keys, *order, *needs))]
    record = _record(named)

    class Generator:
        def __init__(self):
            self._made = factory()

        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError("the generator takes a table: pass df.asTable()")
            missing = [c for c in named if c not in rows.dataType.fieldNames()]
            if missing:
                raise ValueError(f"the generator needs the columns {missing}")
            chunked = _CHUNK in rows.dataType.fieldNames()
            return AnalyzeResult(
                schema=result,
                partitionBy=[PartitioningColumn(f"`{k}`") for k in keys],
                orderBy=[OrderingColumn(f"`{c}`") for c in ([_CHUNK] if chunked else order)],
                select=[SelectedColumn(f"`{c}`") for c in ([*named, _CHUNK] if chunked else named)],
            )

        def eval(self, row: Row):
            if _CHUNK not in row.__fields__:
                yield from self._made.add(row)
                return
            values = dict(zip(row.__fields__, row))
            columns = [repeat(values[c]) if c in keys else values[c] for c in named]
            add = self._made.add
            for one in map(record, zip(*columns)):
                if made := add(one):
                    yield from made

        def terminate(self):
            yield from self._made.finish()

    return F.udtf(Generator)
