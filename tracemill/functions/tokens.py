"""Token-array expressions: windows, segments, labels, masks. All are row-local."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import constants as K
from .text import as_column, uniform, uniform_int


def _int(value) -> Column:
    return F.lit(value) if isinstance(value, int) else as_column(value)


def hashed_token_ids(words, vocabulary: int = 30000, reserved: int = 10) -> Column:
    """Ids for whitespace tokens without a vocabulary; ids below `reserved` stay free for markers."""
    return F.transform(
        as_column(words),
        lambda w: (
            F.conv(F.substring(F.md5(w.cast("binary")), 1, 7), 16, 10).cast("int") % vocabulary + reserved
        ),
    )


def truncate(ids, limit: int) -> Column:
    return F.slice(as_column(ids), 1, limit)


def window_start(ids, length: int, seed, *keys) -> Column:
    """Uniform 0-based start of a `length` window; 0 when everything fits."""
    size = F.size(as_column(ids))
    return F.when(size <= length, F.lit(0)).otherwise(
        uniform_int(size - length + 1, seed, *keys).cast("int")
    )


def random_window(ids, length: int, seed, *keys) -> Column:
    """At most `length` consecutive tokens from a uniform start."""
    return F.slice(as_column(ids), window_start(ids, length, seed, *keys) + 1, F.lit(length))


def window_and_rest(ids, length: int, lm_ratio: float, seed, *keys) -> Column:
    """struct<head, tail>. With probability `lm_ratio` the row becomes a continuation task:
    a short text is cut at a random point, a long one keeps a window and what follows it.
    Otherwise the tail is empty and the head is the random window."""
    ids = as_column(ids)
    size = F.size(ids)
    continuation = uniform(f"{seed}-task", *keys) < lm_ratio
    start = window_start(ids, length, f"{seed}-window", *keys)
    cut = uniform_int(size, f"{seed}-cut", *keys).cast("int") + 1
    short = continuation & (size <= length)
    head_end = F.when(short, cut).otherwise(F.least(start + length, size))
    tail = F.when(continuation, F.slice(ids, head_end + 1, F.greatest(size - head_end, F.lit(0)))).otherwise(
        F.slice(ids, F.lit(1), F.lit(0))
    )
    return F.struct(F.slice(ids, start + 1, head_end - start).alias("head"), tail.alias("tail"))


def is_continuation(tail, min_tokens: int = K.MIN_TOKENS_FOR_LM) -> Column:
    return F.size(as_column(tail)) > min_tokens


def segment_count(ids, slots: int = K.MEMORY_SLOTS, rate: int = K.COMPRESSION_RATE) -> Column:
    return F.ceil(F.size(as_column(ids)) / F.lit(slots * rate)).cast("int")


def segments(ids, count) -> Column:
    """Equal segments of ceil(size / count) tokens; empty trailing slices are dropped."""
    ids, count = as_column(ids), _int(count)
    width = F.ceil(F.size(ids) / count).cast("int")
    slices = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(ids, i * width + 1, width))
    return F.filter(slices, lambda s: F.size(s) > 0)


def _marker_array(ids: list[int]) -> Column:
    return F.array(*[F.lit(i) for i in ids])


def autoencoding_row(answer_ids, memory_ids: list[int], task_id: int, end_id: int) -> Column:
    """struct<prompt_answer_ids, labels>: memory slots and task marker, then the answer and its end."""
    prompt = _marker_array([*memory_ids, task_id])
    answer = F.concat(as_column(answer_ids), _marker_array([end_id]))
    masked = F.array_repeat(F.lit(K.IGNORED_LABEL), len(memory_ids) + 1)
    return F.struct(
        F.concat(prompt, answer).alias("prompt_answer_ids"), F.concat(masked, answer).alias("labels")
    )


def continuation_row(tail, prompt_size, memory_id: int, leave: int, task_id: int | None = None) -> Column:
    """struct<prompt_answer_ids, labels> of a continuation task: memory slots (and marker), then the
    tail without an end token; the first `leave` answer labels are ignored as well."""
    tail, size = as_column(tail), _int(prompt_size)
    prompt = F.array_repeat(F.lit(memory_id), size)
    if task_id is not None:
        prompt, size = F.concat(prompt, _marker_array([task_id])), size + 1
    ignored = size + F.least(F.lit(leave), F.size(tail))
    return F.struct(
        F.concat(prompt, tail).alias("prompt_answer_ids"),
        F.concat(
            F.array_repeat(F.lit(K.IGNORED_LABEL), ignored),
            F.slice(tail, F.lit(leave + 1), F.greatest(F.size(tail) - leave, F.lit(0))),
        ).alias("labels"),
    )


def round_up(size, multiple: int | None) -> Column:
    size = as_column(size)
    return size if not multiple else (F.floor((size - 1) / multiple) + 1).cast("int") * multiple


def pad_right(ids, size, fill: int) -> Column:
    ids, size = as_column(ids), as_column(size)
    return F.concat(ids, F.array_repeat(F.lit(fill), size - F.size(ids)))


def padding_mask(ids, pad_id: int) -> Column:
    return F.transform(as_column(ids), lambda i: i == pad_id)


def drop_condition(ids, marker_id: int, null_id: int, seed, *keys, prob: float = K.CONDITION_DROP_PROB) -> Column:
    """With probability `prob` blank the tokens between the first one and the first marker."""
    ids = as_column(ids)
    marker = F.array_position(ids, F.lit(marker_id)).cast("int")
    blanked = F.concat(
        F.slice(ids, 1, 1), F.array_repeat(F.lit(null_id), marker - 2), F.slice(ids, marker, F.size(ids))
    )
    return F.when((uniform(seed, *keys) < prob) & (marker > 2), blanked).otherwise(ids)
