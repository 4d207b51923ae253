"""Token counts of documents in flat token files: a separator scan.

A flat file is nothing but ids, one document after another, each closed by an end-of-document id; there is
no index. A table of its blocks (file, block number, bytes) is scanned block by block: one vectorised
search finds the separators, and yields the lengths of the documents that start and end in the block,
the tokens before its first and after its last separator. What a block's first separator closes began in
an earlier block; a prefix scan over the summaries of blocks, in two levels so that no file is scanned in
one task, gives the place of each block and of the last separator before it.

The files are made with a text's own `<|endoftext|>` read as ordinary text, so that no text can forge the separator,
and an id that does not fit the files' width ends the job.

Nulls and edges: a null text is empty and has no tokens; a very long one runs over as many blocks as it needs; null ids
and rows that repeat are documents of their own; an empty table has no blocks and no counts; of the given tables only
the columns named are read, whatever others they have. An empty block holds nothing; a file whose last document is not closed ends in a
document marked so; a null block is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import tokens

BLOCK_TOKENS = 1 << 17
SEPARATOR = 50256
STRIDE = 1024  # blocks of a file whose summaries are scanned together


def _write_blocks(path: str, separator: int, size: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, block, held, ids = TaskContext.get().partitionId(), 0, 0, []

        def made(flat: np.ndarray, named: list) -> pa.RecordBatch:
            if flat.max(initial=0) > np.iinfo(dtype).max:
                raise ValueError(f"id {flat.max()} does not fit in {dtype}: choose wider ids for this vocabulary")
            return pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([block]), pa.array([flat.astype(dtype).tobytes()], pa.binary()), pa.array([named], pa.list_(pa.int64()))],
                names=["file", "block", "data", "doc_ids"],
            )

        pending: list[np.ndarray] = []
        for batch in batches:
            for name, own in zip(batch["doc_id"].to_pylist(), tokens.encode_column(batch["text"], path, added=False)):
                ids.append(name)
                pending.append(np.append(own, separator))
                held += len(own) + 1
                if held >= size:
                    flat = np.concatenate(pending)
                    while len(flat) >= size:
                        yield made(flat[:size], ids)
                        flat, ids, block = flat[size:], [], block + 1
                    pending, held = [flat], len(flat)
        if held:
            yield made(np.concatenate(pending), ids)

    return run


def flat_blocks(
    docs: DataFrame, doc_id: str, text: str, path: str, separator: int = SEPARATOR, size: int = BLOCK_TOKENS, dtype: str = "<u2"
) -> DataFrame:
    """Flat token files made from documents, one per partition, as blocks of `size` ids that pay no heed
    to where documents end. `doc_ids` lists the documents begun since the block before; the scan does not
    look at it. Blocks take the numbers of their files from the task, so the result must be written once."""
    plain = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return plain.mapInArrow(
        _write_blocks(path, separator, size, dtype), "file bigint, block bigint, data binary, doc_ids array<bigint>"
    )


def _scan(separator: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch["data"]:
                ids = np.frombuffer(data.as_py() or b"", dtype)
                at = np.flatnonzero(ids == separator)
                rows.append((len(ids), at))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["file"],
                    batch["block"],
                    pa.array([n for n, _ in rows], pa.int64()),
                    pa.array([at for _, at in rows], pa.list_(pa.int64())),
                ],
                names=["file", "block", "n", "ends"],
            )

    return run


def scan_blocks(blocks: DataFrame, separator: int = SEPARATOR, dtype: str = "<u2") -> DataFrame:
    """Summary of each block: file, block, n (tokens) and ends (places of separators in it)."""
    return blocks.select("file", "block", "data").mapInArrow(
        _scan(separator, dtype), "file bigint, block bigint, n bigint, ends array<bigint>"
    )


def count_tokens(summaries: DataFrame) -> DataFrame:
    """Per document: file, ordinal in the file, start, n_tokens (without separator) and closed."""
    s = summaries.withColumn("stride", F.floor(F.col("block") / STRIDE)).withColumn("docs", F.size("ends").cast("bigint"))
    s = s.withColumn("last", F.element_at("ends", F.when(F.col("docs") > 0, -1).otherwise(F.lit(None))))
    inner = Window.partitionBy("file", "stride").orderBy("block")
    upto = inner.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    s = s.select(
        "*",
        F.coalesce(F.sum("n").over(upto), zero).alias("n_before"),
        F.coalesce(F.sum("docs").over(upto), zero).alias("docs_before"),
    ).withColumn("last_at", F.col("n_before") + F.col("last"))
    s = s.withColumn("last_before", F.max("last_at").over(upto))
    # The same again over strides; their summaries are 1/1024 of the blocks.
    sums = s.groupBy("file", "stride").agg(F.sum("n").alias("sn"), F.sum("docs").alias("sdocs"), F.max("last_at").alias("slast"), F.max("block").alias("top"))
    outer = Window.partitionBy("file").orderBy("stride")
    upto = outer.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("n0", F.coalesce(F.sum("sn").over(upto), zero)).withColumn("docs0", F.coalesce(F.sum("sdocs").over(upto), zero))
    sums = sums.withColumn("last0", F.max(F.col("n0") + F.col("slast")).over(upto))
    sums = sums.withColumn("final", F.lead("top").over(outer).isNull())
    s = s.join(sums.select("file", "stride", "n0", "docs0", "last0", "top", "final"), ["file", "stride"])
    s = s.withColumn("place", F.col("n0") + F.col("n_before"))
    s = s.withColumn("open", F.coalesce(F.col("n0") + F.col("last_before"), F.col("last0"), F.lit(-1)) + 1)
    ends = F.transform("ends", lambda e: F.col("place") + e)
    # An unclosed document at the end of a file ends there.
    total = F.col("place") + F.col("n")
    tail = F.coalesce(F.element_at(ends, F.when(F.size(ends) > 0, -1).otherwise(F.lit(None))) + 1, F.col("open"))
    unclosed = F.col("final") & (F.col("block") == F.col("top")) & (tail < total)
    s = s.select("file", "open", (F.col("docs0") + F.col("docs_before")).alias("ordinal0"), ends.alias("ends"), F.when(unclosed, total).alias("cut"))
    all_ends = F.concat("ends", F.when(F.col("cut").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("cut")))
    s = s.withColumn("all_ends", all_ends)
    rows = F.transform(
        "all_ends",
        lambda e, i: F.struct(
            (F.col("ordinal0") + i).alias("ordinal"),
            F.coalesce(F.get(F.col("all_ends"), i - 1) + 1, F.col("open")).alias("start"),
            e.alias("end"),
            (~F.coalesce(e == F.col("cut"), F.lit(False))).alias("closed"),
        ),
    )
    out = s.select("file", F.explode(rows).alias("d"))
    return out.select("file", "d.ordinal", "d.start", (F.col("d.end") - F.col("d.start")).alias("n_tokens"), "d.closed")


def named_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Write the documents as flat files, count, and put the ids of the documents to the counts."""
    from .common import save

    blocks = save(flat_blocks(docs, doc_id, text, path or tokens.vocabulary_path()), "flat-tokens")
    counted = count_tokens(save(scan_blocks(blocks), "separators"))
    inner = Window.partitionBy("file", "stride").orderBy("block")
    upto = inner.rowsBetween(Window.unboundedPreceding, -1)
    names = blocks.select("file", "block", F.floor(F.col("block") / STRIDE).alias("stride"), "doc_ids", F.size("doc_ids").alias("k"))
    names = names.withColumn("before", F.coalesce(F.sum("k").over(upto), F.lit(0)))
    sums = names.groupBy("file", "stride").agg(F.sum("k").alias("k"))
    upto = Window.partitionBy("file").orderBy("stride").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("file", "stride", F.coalesce(F.sum("k").over(upto), F.lit(0)).alias("before0"))
    names = names.join(sums, ["file", "stride"])
    named = names.select("file", (F.col("before0") + F.col("before")).alias("base"), F.posexplode("doc_ids").alias("i", "doc_id"))
    named = named.select("file", (F.col("base") + F.col("i")).alias("ordinal"), "doc_id")
    return counted.join(named, ["file", "ordinal"])
