"""String helpers with Python's notion of whitespace, and hash-based randomness.

Everything is a built-in expression, so the helpers stay in generated code and
work on batch and streaming DataFrames alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from . import constants as K


def as_column(value) -> Column:
    """Names become columns, columns pass through (the usual ColumnOrName rule)."""
    return value if isinstance(value, Column) else F.col(value)


def strip(text) -> Column:
    """Remove whitespace at both ends (Unicode aware; SQL trim only knows the space)."""
    return F.btrim(as_column(text), F.lit(K.WHITESPACE))


def strip_chars(text, chars: str) -> Column:
    return F.btrim(as_column(text), F.lit(chars))


def is_blank(text) -> Column:
    return strip(text) == ""


def empty_to_null(text) -> Column:
    return F.nullif(as_column(text), F.lit(""))


def find_all(text, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(as_column(text), F.lit(pattern), F.lit(group))


def last_match(text, pattern: str, group: int) -> Column:
    """Last match of a pattern, null when there is none."""
    return F.try_element_at(find_all(text, pattern, group), F.lit(-1))


def lines(text) -> Column:
    return F.split(as_column(text), K.LINE_END)


def words(text) -> Column:
    """Whitespace tokens without empties."""
    return F.filter(F.split(as_column(text), K.WHITESPACE_CLASS + "+"), lambda w: w != "")


def last_line(text) -> Column:
    """Last line of a stripped text, stripped again."""
    return strip(F.try_element_at(lines(text), F.lit(-1)))


def after_last(text, marker: str) -> Column:
    return F.substring_index(as_column(text), marker, -1)


def before_last(text, marker: str) -> Column:
    text = as_column(text)
    kept = F.length(text) - F.length(after_last(text, marker)) - len(marker)
    return F.substring(text, F.lit(1), kept)


def tail_lines(text, count: int) -> Column:
    """The last `count` newline-separated lines, joined again."""
    parts = F.split(as_column(text), "\n")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - (count - 1), F.lit(1)), F.lit(count)), "\n")


def shard_name(shard_id) -> Column:
    """The shard id with at least six digits behind the fixed prefix."""
    digits = as_column(shard_id).cast("string")
    return F.concat(F.lit(K.SHARD_NAME_PREFIX), F.lpad(digits, F.greatest(F.length(digits), F.lit(6)), F.lit("0")))


# Randomness ------------------------------------------------------------------
# rand()/randn() depend on partitioning and row order, so a retried or repartitioned
# job would draw other numbers. These draws are functions of (seed, key) alone.


def hash_key(seed, *keys) -> Column:
    """32 hex digits that are a function of the seed and the key columns."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[as_column(k).cast("string") for k in keys]).cast("binary"))


def _hex_fraction(digest: Column, start: int) -> Column:
    """13 hex digits of a digest as a number in [0, 1)."""
    return F.conv(F.substring(digest, start, 13), 16, 10).cast("double") / F.lit(float(2**52))


def uniform(seed, *keys) -> Column:
    """Reproducible uniform draw in [0, 1)."""
    return _hex_fraction(hash_key(seed, *keys), 1)


def uniform_int(bound, seed, *keys) -> Column:
    """Reproducible integer draw in [0, bound)."""
    return F.floor(uniform(seed, *keys) * bound).cast("long")


def normal_pair(digest: Column) -> Column:
    """Two standard normals (Box-Muller) from one digest: 104 of its 128 bits are used."""
    radius = F.sqrt(-2.0 * F.log(1.0 - _hex_fraction(digest, 1)))
    angle = 2.0 * math.pi * _hex_fraction(digest, 14)
    return F.array(radius * F.cos(angle), radius * F.sin(angle))


def normal_vector(size, seed, *keys) -> Column:
    """`size` standard normals per row; one digest serves two elements."""
    size = F.lit(size) if isinstance(size, int) else size
    pairs = F.transform(
        F.sequence(F.lit(0), F.floor((size - 1) / 2).cast("int")),
        lambda i: normal_pair(hash_key(seed, *keys, i)),
    )
    return F.slice(F.flatten(pairs), F.lit(1), size.cast("int"))
