"""Queries over token arrays of whole documents."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import tokens as K
from ..operators import batches
from ..operators.numbering import natural_order, shuffled_order
from . import inputs, oracle as O
from .registry import query

PAD, END, TASK, MARKER, NULL_ID = 0, 2, 3, 5, 9
MEMORY = [40000, 40001, 40002]
WINDOW, LM_RATIO, MIN_LM, LEAVE = 96, 0.5, 16, 4
SLOTS, RATE = 3, 16
BATCH, MULTIPLE, SEED = 16, 8, 42


def _ids(array) -> Column:
    return F.array_join(F.transform(array, lambda i: i.cast("string")), ",")


def _digest(array) -> Column:
    return F.md5(_ids(array).cast("binary"))


def _md5(x: str) -> str:
    return f"md5({O.joined(x)})"


def _start(length: int, seed: str) -> str:
    draw = O.draw(seed, "doc_id")
    return f"(case when len(ids) <= {length} then 0 else cast(floor({draw} * (len(ids) - {length} + 1)) as bigint) end)"


@query(f"with {O.TOKENS} select doc_id, len(ids) as size, {_md5('ids')} as ids from tokens")
def token_ids(spark, sf_dir):
    """Hashed ids of every document's tokens."""
    return inputs.tokens(spark, sf_dir).select("doc_id", F.size("ids").alias("size"), _digest("ids").alias("ids"))


@query(
    f"""with {O.TOKENS}, s as (select *, {_start(WINDOW, 'crop')} as start from tokens)
    select doc_id, {O.joined(f'ids[start + 1:start + {WINDOW}]')} as ids from s"""
)
def crop(spark, sf_dir):
    """A random window of every document."""
    return inputs.tokens(spark, sf_dir).select("doc_id", _ids(K.random_window("ids", WINDOW, "crop", "doc_id")).alias("ids"))


_LM_SQL = f"""{O.TOKENS},
lm0 as (select doc_id, ids, {O.draw('lm-task', 'doc_id')} < {LM_RATIO} as lm, {_start(WINDOW, 'lm-window')} as start,
   cast(floor({O.draw('lm-cut', 'doc_id')} * len(ids)) as bigint) + 1 as cut from tokens),
lm1 as (select *, case when lm and len(ids) <= {WINDOW} then cut else least(start + {WINDOW}, len(ids)) end as stop from lm0),
lm as (select doc_id, ids[start + 1:stop] as head, case when lm then ids[stop + 1:len(ids)] else [] end as tail from lm1)
"""


def _split(spark, sf_dir):
    cut = K.window_and_rest("ids", WINDOW, LM_RATIO, "lm", "doc_id").alias("cut")
    return inputs.tokens(spark, sf_dir).select("doc_id", cut).select("doc_id", "cut.*")


@query(f"with {_LM_SQL} select doc_id, {O.joined('head')} as head, len(tail) as tail_size, {_md5('tail')} as tail from lm")
def lm_split(spark, sf_dir):
    """Head and continuation of every document."""
    return _split(spark, sf_dir).select(
        "doc_id", _ids("head").alias("head"), F.size("tail").alias("tail_size"), _digest("tail").alias("tail")
    )


@query(f"with {O.TOKENS} select doc_id, cast(ceil(len(ids) / {SLOTS * RATE}::double) as bigint) as segments from tokens")
def num_segments(spark, sf_dir):
    """Segments needed per document."""
    return inputs.tokens(spark, sf_dir).select("doc_id", K.segment_count("ids", SLOTS, RATE).alias("segments"))


@query(
    f"""with {O.TOKENS}, c as (select *, cast(ceil(len(ids) / {SLOTS * RATE}::double) as bigint) as n from tokens),
    w as (select *, cast(ceil(len(ids) / n::double) as bigint) as width from c),
    x as (select doc_id, i as segment_idx, ids[i * width + 1:(i + 1) * width] as segment from (select *, unnest(range(n)) as i from w))
    select doc_id, segment_idx, {O.joined('segment')} as segment from x where len(segment) > 0"""
)
def segments(spark, sf_dir):
    """One row per segment of every document."""
    counted = inputs.tokens(spark, sf_dir).withColumn("n", K.segment_count("ids", SLOTS, RATE))
    return batches.segment_rows(counted, "ids", "n").select("doc_id", "segment_idx", _ids("ids").alias("segment"))


_ROWS_SQL = f"""{O.TOKENS},
assembled as (select doc_id, ids as input_ids, list_concat({MEMORY + [TASK]}, list_append(ids, {END})) as prompt_answer_ids,
   list_concat({[-100] * (len(MEMORY) + 1)}, list_append(ids, {END})) as labels from tokens)
"""


def _rows(spark, sf_dir):
    row = K.autoencoding_row("ids", MEMORY, TASK, END).alias("row")
    return inputs.tokens(spark, sf_dir).select("doc_id", F.col("ids").alias("input_ids"), row).select(
        "doc_id", "input_ids", "row.*"
    )


@query(
    f"""with {_ROWS_SQL} select doc_id, len(labels) as size, len(labels) = len(prompt_answer_ids) as equal_sizes,
      {_md5('prompt_answer_ids')} as prompt_answer_ids, {_md5('labels')} as labels from assembled"""
)
def assemble(spark, sf_dir):
    """Prompt, answer and labels of every document."""
    return _rows(spark, sf_dir).select(
        "doc_id",
        F.size("labels").alias("size"),
        (F.size("labels") == F.size("prompt_answer_ids")).alias("equal_sizes"),
        _digest("prompt_answer_ids").alias("prompt_answer_ids"),
        _digest("labels").alias("labels"),
    )


@query(
    f"""with {_LM_SQL}, t as (select doc_id, tail[1:{WINDOW}] as tail from lm where len(tail) > {MIN_LM})
    select doc_id, {O.joined(f'list_concat({[MEMORY[0]] * len(MEMORY)}, tail)')} as prompt_answer_ids,
      {O.joined(f'list_concat({[-100] * (len(MEMORY) + LEAVE)}, tail[{LEAVE + 1}:])')} as labels from t"""
)
def lm_labels(spark, sf_dir):
    """Continuation rows with their partly ignored labels."""
    tails = _split(spark, sf_dir).filter(K.is_continuation("tail", MIN_LM))
    row = K.continuation_row(K.truncate("tail", WINDOW), len(MEMORY), MEMORY[0], LEAVE)
    return tails.select("doc_id", row.alias("row")).select(
        "doc_id", _ids("row.prompt_answer_ids").alias("prompt_answer_ids"), _ids("row.labels").alias("labels")
    )


def _padded(x: str, size: str, fill: int) -> str:
    return f"list_concat({x}, list_transform(range({size} - len({x})), lambda i: {fill}))"


def _up(x: str) -> str:
    return f"((({x}) - 1) // {MULTIPLE} + 1) * {MULTIPLE}"


def _batches_sql(order: str) -> str:
    return f"""{_ROWS_SQL}, placed as (select *, row_number() over (order by {order}) - 1 as p from assembled),
    b as (select *, p // {BATCH} as batch_id, p % {BATCH} as batch_row from placed),
    m as (select *, {_up('max(len(input_ids)) over (partition by batch_id)')} as m1,
                    {_up('max(len(labels)) over (partition by batch_id)')} as m2 from b)
    select doc_id, batch_id, batch_row, m1 as input_size, m2 as label_size, {_md5(_padded('input_ids', 'm1', PAD))} as input_ids,
      {_md5(_padded('prompt_answer_ids', 'm2', PAD))} as prompt_answer_ids, {_md5(_padded('labels', 'm2', -100))} as labels from m"""


def _pad(rows, order):
    fills = {"input_ids": PAD, "prompt_answer_ids": PAD, "labels": -100}
    df = batches.pad_batches(rows, "doc_id", order, fills, BATCH, MULTIPLE)
    return df.select(
        "doc_id",
        "batch_id",
        "batch_row",
        F.size("input_ids").alias("input_size"),
        F.size("labels").alias("label_size"),
        *[_digest(c).alias(c) for c in fills],
    )


@query(f"with {_batches_sql('doc_id')}")
def pad_batches(spark, sf_dir):
    """Batches in file order, padded to a multiple."""
    rows = _rows(spark, sf_dir)
    return _pad(rows, natural_order(inputs.table(spark, sf_dir, "documents"), "doc_id"))


@query(f"with {_batches_sql(O.digest(str(SEED), 'doc_id') + ', doc_id')}")
def shuffled_batches(spark, sf_dir):
    """The same in shuffled order."""
    return _pad(_rows(spark, sf_dir), shuffled_order("doc_id", SEED))


@query(f"with {O.TOKENS} select doc_id, {O.joined(f'ids[1:{WINDOW}]')} as ids from tokens")
def truncate(spark, sf_dir):
    """The first tokens of every document, as a length limit keeps them."""
    return inputs.tokens(spark, sf_dir).select("doc_id", _ids(K.truncate("ids", WINDOW)).alias("ids"))


_MARKED_SQL = f"{O.TOKENS}, marked as (select doc_id, list_concat(list_append(ids[1:doc_id % 40], {MARKER}), ids[doc_id % 40 + 1:]) as ids from tokens)"


def _marked(spark, sf_dir):
    """Documents with a marker placed after some of their tokens."""
    place = (F.col("doc_id") % 40).cast("int")
    ids = F.concat(
        F.slice("ids", F.lit(1), place), F.array(F.lit(MARKER)), F.slice("ids", place + 1, F.size("ids"))
    )
    return inputs.tokens(spark, sf_dir).select("doc_id", ids.alias("ids"))


@query(
    f"""with {_MARKED_SQL}, p as (select *, list_position(ids, {MARKER}) as m from marked)
    select doc_id, {_md5(f'''case when {O.draw('drop', 'doc_id')} < 0.4 and m > 2
       then list_concat(list_append(ids[1:1], {NULL_ID})[1:1], list_transform(range(m - 2), lambda i: {NULL_ID}), ids[m:]) else ids end''')} as ids from p"""
)
def cond_dropout(spark, sf_dir):
    """Conditions blanked before the marker."""
    dropped = K.drop_condition("ids", MARKER, NULL_ID, "drop", "doc_id", prob=0.4)
    return _marked(spark, sf_dir).select("doc_id", _digest(dropped).alias("ids"))


@query(
    f"""with {O.TOKENS} select doc_id, {O.joined(f"list_transform({_padded('ids', '10 * ((len(ids) + 9) // 10)', PAD)}, lambda i: (i = {PAD})::int)")} as mask from tokens"""
)
def pad_mask(spark, sf_dir):
    """Padding mask of documents padded to a multiple of ten."""
    padded = K.pad_right("ids", K.round_up(F.size("ids"), 10), PAD)
    mask = F.transform(K.padding_mask(padded, PAD), lambda m: m.cast("int").cast("string"))
    return inputs.tokens(spark, sf_dir).select("doc_id", F.array_join(mask, ",").alias("mask"))
