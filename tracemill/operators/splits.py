"""Reproducible exact-size splits, samples, shuffles and heads.

Every selection is "composite key <= cut key", with the cut key found by `numbering`.
The data itself is read once, is not shuffled, and may be written straight into one
directory per split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import as_column
from .numbering import cut_keys, natural_order, shuffled_order, with_position


def _check(fine: bool, message: str) -> None:
    """Sizes are checked when the split is made, so that an empty table or a query that reads other
    columns only cannot skip it."""
    if not fine:
        raise ValueError(message)


def seeded_shuffle(df: DataFrame, id_col: str, seed: int = 42, output: str = "position") -> DataFrame:
    """Append the row's position in a seeded shuffle. Sort by it where file order matters."""
    return with_position(df, shuffled_order(id_col, seed), output)


def three_way_split(
    df: DataFrame, id_col: str, val_size: int, test_size: int, seed: int = 42, output: str = "split"
) -> DataFrame:
    """The first `val_size` shuffled rows are val, the next `test_size` test, the others train.
    Fails when nothing would be left for train."""
    if val_size < 0 or test_size < 0:
        raise ValueError("split sizes must not be negative")
    _check(df.count() > val_size + test_size, "val_size + test_size must be smaller than the dataset size")
    order = shuffled_order(id_col, seed)
    sizes = {"val": val_size, "test": val_size + test_size}
    names = [n for n, end in sizes.items() if end > 0 and not (n == "test" and test_size == 0)]
    label = F.lit("train")
    if names:
        cuts = cut_keys(df, order, [sizes[n] for n in names])
        for name, cut in reversed(list(zip(names, cuts))):
            label = F.when(order.composite <= cut, F.lit(name)).otherwise(label)
    return df.withColumn(output, label)


def holdout_split(
    df: DataFrame,
    id_col: str,
    holdout_size: int,
    seed: int = 42,
    names: tuple[str, str] = ("valid", "train"),
    output: str = "split",
) -> DataFrame:
    """Label `holdout_size` shuffled rows with the first name and the rest with the second."""
    order = shuffled_order(id_col, seed)
    (cut,) = cut_keys(df, order, [holdout_size])
    return df.withColumn(
        output, F.when(F.coalesce(order.composite <= cut, F.lit(True)), F.lit(names[0])).otherwise(F.lit(names[1]))
    )


def train_test_split(
    df: DataFrame, id_col: str, test_size: int | float, seed: int, output: str = "split"
) -> DataFrame:
    """Two-way split by a row count, or by a fraction (rounded up). Fails when either side would be empty."""
    rows = df.count()
    if isinstance(test_size, float):
        test_size = -int(-rows * test_size // 1)
    _check(0 < test_size < rows, f"test_size={test_size} leaves one side of {rows} rows empty")
    return holdout_split(df, id_col, test_size, seed, ("test", "train"), output)


def seeded_sample(df: DataFrame, id_col: str, size: int, seed: int = 42) -> DataFrame:
    """Exactly `size` rows without replacement. Fails when there are fewer."""
    _check(0 <= size <= df.count(), "sample larger than the dataset")
    order = shuffled_order(id_col, seed)
    (cut,) = cut_keys(df, order, [size])
    return df.filter(order.composite <= cut)


def first_rows(df: DataFrame, line_col: str, size: int) -> DataFrame:
    """The first `size` rows in file order, whatever gaps the line numbers have."""
    order = natural_order(df, line_col)
    (cut,) = cut_keys(df, order, [size])
    return df.filter(F.coalesce(order.composite <= cut, F.lit(True)))


def first_lines(df: DataFrame, line_col: str, size: int) -> DataFrame:
    """The rows among the first `size` file lines, counting blank lines too: a pushed-down filter."""
    return df.filter(as_column(line_col) < size)


def membership_split(
    df: DataFrame, chosen: DataFrame, key: str, names: tuple[str, str] = ("in", "out"), output: str = "split"
) -> DataFrame:
    """Rows whose key is, and is not, in `chosen`: one join that reads both tables once. Catalyst
    broadcasts the distinct keys when their size allows; else a hot key's rows can be split."""
    keys = chosen.select(key).distinct().withColumn("__in", F.lit(True))
    label = F.when(F.col("__in"), F.lit(names[0])).otherwise(F.lit(names[1]))
    return df.join(keys, key, "left").withColumn(output, label).drop("__in")


def split_counts(df: DataFrame, split_col: str = "split") -> DataFrame:
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("rows"))


def hardest(df: DataFrame, difficulty: list[str], line_col: str, size: int = 500) -> DataFrame:
    """Top-k report: largest by the difficulty columns, earlier line first on ties."""
    return df.orderBy(*[F.desc(c) for c in difficulty], F.asc(line_col)).limit(size)
