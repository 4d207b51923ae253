"""Best-fit packing of tokenised documents into sequences of bounded length.

Lengths are small integers, so documents of one length are interchangeable, and so are gaps of one size: the
state of the packing is two tables of counts, documents by length and runs of sequences by gap, whatever the
corpus. `superstep` sorts both by size and sweeps from large to small. A gap goes on a stack, a document takes
the top, which is its successor: the smallest gap that holds it and that no longer document took. So the sweep
is a matching of brackets, found for all sizes at once by prefix sums (`high`) and, where several classes want the
same gaps, by the rank of slots on the stack. The gaps then shrink, and the next step matches what is left; each
gap takes one document a step, or one bundle of equal documents where these outnumber the gaps. Documents that
no gap can hold any more open as many sequences as they need at the least. Steps end when all is placed: 16 on
the small test table, since a sequence holds few documents. Each step is written, so a lost executor costs one.

Only the steps' control sums reach the driver. The rows never leave the executors: they are hashed by length into
shares of bounded size, ranked within these by a prefix sum over shares, and meet the run that covers their rank.

Nulls and edges: a null text is empty and packs as its end token; null ids are allowed; rows that repeat
are packed once per row; a text is tokenised whole, whatever its length, and cut into pieces after that; documents
of one length tie, and take their places by a hash of id and text; a text's added tokens are recognised, as by
their library; an empty table gives an empty result. Only the columns named are read, whatever others the table has.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import tokens
from .common import row_key, save

MAX_TOKENS = 1024
END_TOKEN = 2
#: Rows that rank within one task.
RANK_ROWS = 50_000
#: Columns of the counted state: documents of one size by rank, runs of sequences with equal gaps, runs placed.
STATE = [("kind", "string"), *[(c, "bigint") for c in ("size", "first", "n", "take", "sequence", "offset")]]


def _pieces_of(path: str, end_token: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(tokens.encode_column(batch["text"], path)):
                ids = np.append(ids, end_token).astype("<u4")
                cuts = [0, *range(len(ids) - (len(ids) - 1) // most * most, len(ids) + 1, most)]
                for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(i)
                    piece.append(p)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].take(at),
                    pa.array(piece, pa.int32()),
                    *[pa.array(x, pa.int64()) for x in (start, length, crc)],
                    batch["salt"].take(at),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"],
            )

    return run


def cut_pieces(
    docs: DataFrame, doc_id: str, text: str, path: str, end_token: int = END_TOKEN, most: int = MAX_TOKENS
) -> DataFrame:
    """Pieces of the tokenised documents, without their ids: of a longer document all but the first
    hold `most` tokens."""
    plain = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), row_key(doc_id, text)["a"].alias("salt")
    )
    kind = plain.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, salt bigint"
    return plain.mapInArrow(_pieces_of(path, end_token, most), schema)


def superstep(state: DataFrame, most: int) -> DataFrame:
    """One bulk step over counted documents and gaps (rows of `STATE`): what it places as rows of kind `run`,
    and the documents and gaps it leaves. The tables have a row per length and per run of gaps, so that their
    sweeps are small sorts."""
    gap = F.col("kind") == "gap"
    everywhere = Window.partitionBy()
    found = state.coalesce(1).withColumn("shortest", F.min(F.when(~gap, F.col("size"))).over(everywhere)).filter(
        ~gap | (F.col("size") >= F.col("shortest"))
    )
    # A class with more documents than gaps that hold one goes in bundles of equal documents.
    down = Window.orderBy(F.desc("size"), F.desc("kind"), "first")
    found = found.withColumn("fits", F.sum(F.when(gap, F.col("n")).otherwise(0)).over(down))
    found = found.withColumn("top", F.max(F.when(gap, F.col("size"))).over(everywhere))
    bundle = F.greatest(F.lit(1), F.least(F.expr("n div fits"), F.expr("top div size"))).cast("bigint")
    found = found.withColumn("take", F.when(~gap & (F.col("fits") > 0), bundle).otherwise(F.lit(1).cast("bigint")))
    found = found.withColumn("units", F.expr("n div take"))

    # The sweep from large to small: a gap goes on a stack, a document takes the top, its successor among gaps.
    # The height of the stack is a prefix sum that never falls below zero.
    sweep = Window.orderBy(F.desc(F.col("size") * F.col("take")), F.desc("kind"), "first")
    found = found.withColumn("at", F.row_number().over(sweep))
    sweep = Window.orderBy("at")
    found = found.withColumn("sum", F.sum(F.when(gap, F.col("units")).otherwise(-F.col("units"))).over(sweep))
    found = found.withColumn("high", F.col("sum") - F.least(F.lit(0), F.min("sum").over(sweep)))
    found = found.withColumn("base", F.coalesce(F.lag("high").over(sweep), F.lit(0)))
    after = sweep.rowsBetween(1, Window.unboundedFollowing)
    found = found.withColumn("rest", F.least("high", F.coalesce(F.min("high").over(after), F.col("high"))))
    # Slots that an event gives to documents or takes from gaps: [low, end).
    found = found.withColumn("low", F.when(gap, F.greatest("base", "rest")).otherwise(F.col("high")))
    found = save(found.withColumn("end", F.when(gap, F.col("high")).otherwise(F.col("base"))), "sweep").coalesce(1)

    # Slots cut at all ends of events; within a cell the events alternate: a gap, the document that takes it.
    ends = found.filter("low < end").select("*", F.explode(F.array("low", "end")).alias("cut"))
    ends = ends.withColumn("cell", F.dense_rank().over(Window.orderBy("cut")).cast("bigint"))
    cuts = ends.select("cell", F.col("cut").alias("low")).distinct()
    cuts = cuts.withColumn("end", F.lead("low").over(Window.orderBy("cell")))
    names = ["at", "kind", "size", "first", "take", "base"]
    spans = ends.groupBy(*names).agg(F.min("cell").alias("a"), F.max("cell").alias("z"))
    cells = spans.select(*names, F.explode(F.sequence("a", F.col("z") - 1)).alias("cell"))
    before = Window.partitionBy("cell").orderBy("at")
    pairs = cells.withColumn("gap", F.lag(F.struct("at", "size", "first", "base")).over(before)).filter("kind = 'doc'")
    # The cells of one document class in one run of gaps follow one another.
    met = pairs.join(cuts.hint("merge"), "cell").groupBy(*names, "gap").agg(F.min("low").alias("low"), F.max("end").alias("end"))
    runs = met.select(
        F.lit("run").alias("kind"),
        "size",
        (F.col("first") + (F.col("base") - F.col("end")) * F.col("take")).alias("first"),
        (F.col("end") - F.col("low")).alias("n"),
        "take",
        (F.col("gap.first") + F.col("low") - F.col("gap.base")).alias("sequence"),
        (F.lit(most) - F.col("gap.size")).alias("offset"),
    )
    shrunk = F.struct(
        F.lit("gap").alias("kind"),
        (F.lit(most) - F.col("offset") - F.col("size") * F.col("take")).alias("size"),
        F.col("sequence").alias("first"),
        F.col("n"),
        *[F.lit(None).cast("bigint").alias(c) for c in ("take", "sequence", "offset")],
    )
    made = runs.select(F.inline(F.array(F.struct(*runs.columns), shrunk)))
    taken = F.col("end") - F.col("low")
    kept = found.select(
        "kind",
        "size",
        F.when(gap, F.col("first")).otherwise(F.col("first") + taken * F.col("take")).alias("first"),
        F.when(gap, F.col("rest") - F.col("base")).otherwise(F.col("n") - taken * F.col("take")).alias("n"),
        *[F.lit(None).cast("bigint").alias(c) for c in ("take", "sequence", "offset")],
    )
    return made.unionByName(kept).filter("size > 0 and n > 0").select(*[F.col(c).cast(t) for c, t in STATE])


def best_fit(counted: DataFrame, most: int) -> DataFrame:
    """Runs that place all documents of `counted` (size, n): the documents of one size with ranks from `first`
    go to `n` sequences from `sequence` on, `take` in each, from `offset` on."""
    spark = counted.sparkSession
    rows = {"kind": F.lit("doc"), "size": F.col("size"), "first": F.lit(0), "n": F.col("n")}
    start = counted.select(*[rows.get(c, F.lit(None)).cast(t).alias(c) for c, t in STATE])
    step, steps, opened = save(start.coalesce(1), "step"), [], 0
    while True:
        top = F.coalesce(F.max(F.when(F.col("kind") == "gap", F.col("size"))).over(Window.partitionBy()), F.lit(0))
        doc, tall = F.col("kind") == "doc", F.col("size") > F.col("top")
        left, alone, tokens_left = (
            step.coalesce(1)
            .withColumn("top", top)
            .agg(
                F.sum(F.when(doc, F.col("n"))),
                F.sum(F.when(doc & tall & (2 * F.col("size") > most), F.col("n"))),
                F.sum(F.when(doc & tall, F.col("n") * F.col("size"))),
            )
            .first()
        )
        if not left:
            break
        state = step.filter("kind <> 'run'")
        if tokens_left:
            # No gap will ever hold these: as many sequences as they need at the least.
            more = alone or max(1, tokens_left // most)
            values = {"kind": "gap", "size": most, "first": opened, "n": more}
            state = state.union(spark.range(1).select(*[F.lit(values.get(c)).cast(t).alias(c) for c, t in STATE]))
            opened += more
        step = save(superstep(state, most), "step")
        steps.append(step.filter("kind = 'run'"))
    return reduce(DataFrame.union, steps, step.filter("kind = 'run'").limit(0))


def with_rank(df: DataFrame, by: str, salt: str, output: str) -> DataFrame:
    """Append the 0-based rank of each row among those of equal `by`. Rows are ranked within shares of
    bounded size and the shares follow one another, so no value is ranked in one task."""
    sized = df.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / RANK_ROWS).cast("bigint").alias("__shares"))
    shared = save(
        df.join(F.broadcast(sized), by).withColumn("__share", F.pmod(F.xxhash64(salt), F.col("__shares"))), "shares"
    )
    counts = shared.groupBy(by, "__share").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(by).orderBy("__share").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(by, "__share", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    # A total order up to rows that are equal, so that a task that runs again ranks alike.
    within = Window.partitionBy(by, "__share").orderBy(salt, *[c for c in df.columns if c != salt])
    ranked = shared.withColumn("__row", F.row_number().over(within)).join(first, [by, "__share"])
    return ranked.withColumn(output, F.col("__first") + F.col("__row") - 1).drop(
        "__shares", "__share", "__row", "__first"
    )


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    end_token: int = END_TOKEN,
    most: int = MAX_TOKENS,
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    spark = docs.sparkSession
    pieces = save(cut_pieces(docs, doc_id, text, path or tokens.vocabulary_path(), end_token, most), "pieces")
    counted = pieces.groupBy(F.col("length").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    placed = best_fit(counted, most)
    # Ranks are looked up in the runs of their length, an array sorted by first rank.
    run = F.struct("first", "n", "take", "sequence", "offset")
    runs = placed.groupBy(F.col("size").alias("length")).agg(F.sort_array(F.collect_list(run)).alias("runs"))
    ranked = with_rank(pieces, "length", "salt", "rank")
    # One row per length and few runs in each: bounded by `most`, whatever the number of documents.
    met = ranked.join(F.broadcast(save(runs, "runs")), "length")
    held = F.filter("runs", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") < r["first"] + r["n"] * r["take"]))
    met = met.withColumn("run", F.get(held, F.lit(0))).withColumn("nth", F.col("rank") - F.col("run.first"))
    return met.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("run.sequence") + F.expr("nth div run.take")).alias("sequence_id"),
        (F.col("run.offset") + F.expr("nth % run.take") * F.col("length")).alias("offset"),
    )
