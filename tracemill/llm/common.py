"""Shared helpers: reading tables, tables written to the cluster's shared folder, row keys, word arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.staged import stage as save  # noqa: F401  (the operators write their steps with it)

#: Word patterns of the query contracts. A word of the first kind holds letters, digits and anything
#: beyond ASCII; one of the second kind is whatever stands between ASCII white space.
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE_GAP = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_key(*columns) -> Column:
    """128 bits of a row's values, never null. Rows that agree in all of them share the key."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.struct(
        F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *reversed(parts)).alias("b")
    )


def whole_row(docs: DataFrame) -> Column:
    """All columns of a row as one, so that an operator's own columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def lower_ascii(text) -> Column:
    """Lower-case A-Z only. `lower` does just that to pure ASCII text, and faster."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def split_words(text: Column, gap: str) -> Column:
    """Words between gaps; a null text has none. A gap at either end leaves an empty piece, which goes."""
    pieces = F.split(F.coalesce(text, F.lit("")), gap)
    return F.filter(pieces, lambda w: w != "")


def pair_hash(grams, ahead, by: int) -> Column:
    """Hash of each gram with the one of `ahead` that starts `by` places later (meaningless at the end)."""
    later = F.slice(ahead, by + 1, F.size(ahead) + 1)
    return F.zip_with(grams, later, lambda a, b: F.xxhash64(a, b))


def with_grams(df: DataFrame, hashes: str, output: str, k: int) -> DataFrame:
    """Hashes of all runs of k words, by doubling: each step is one pass over a primitive array."""
    df = df.withColumn(output, F.col(hashes))
    have = 1
    while have < k:
        step = have if 2 * have <= k else k - have
        df = df.withColumn(output, pair_hash(F.col(output), F.col(output), step))
        have += step
    return df.withColumn(
        output, F.slice(F.col(output), 1, F.greatest(F.size(hashes) - (k - 1), F.lit(0)))
    )


def with_window_min(df: DataFrame, grams: str, output: str, w: int) -> DataFrame:
    """Minimum of each run of w grams, by doubling."""
    df = df.withColumn(output, F.col(grams))
    have = 1
    while have < w:
        step = have if 2 * have <= w else w - have
        later = F.slice(F.col(output), step + 1, F.size(output) + 1)
        df = df.withColumn(output, F.zip_with(F.col(output), later, lambda a, b: F.least(a, b)))
        have += step
    return df.withColumn(output, F.slice(F.col(output), 1, F.greatest(F.size(grams) - (w - 1), F.lit(0))))
