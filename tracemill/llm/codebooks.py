"""Product codes of vectors: a codebook per part, fitted by Lloyd's rounds over two trees.

Components become integers, so every distance, sum and mean is exact and the result does not depend on how rows lie.
Vectors are gathered into blocks. In a block each part has a tree: its points are split at the median of their
widest component until at most `LEAF` are left, and every node keeps the box, the sum and the number of its
points. Blocks with their trees are written once. The entries of a codebook get a tree of the same kind
in every round; it is small and built in each task.

A round walks both trees downwards together. For a pair of nodes, the boxes bound the distance between any
point and any entry from below and above: an entry node goes when its nearest is farther than another's
farthest. Single entries also go when, over the whole box, another entry is at least as near (the
difference of two squared distances is linear, so its least value is at a corner). A node with one entry left is
assigned as a whole with its cached sum; leaves that stay undecided compare integers, point by point. Ties go
to the lower index in all of these.

Tasks send at most a row per part, entry and component, which Spark adds up; a codebook is `entries` x
dimension numbers, whatever the number of vectors, and travels by the driver to the next round.

Rows: a vector that is null or holds a null, NaN or infinite component is left out; one whose length differs from
the first vector's by id (or from `dim`), such as an empty one, has no code and no error; null ids come
last; rows that repeat are coded once per row; with fewer vectors than entries the codebooks are shorter; an
empty table gives an empty result. Components so large that a squared distance does not fit in 64 bits end
the job. Only the columns named are read, whatever others the table has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import save

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Points of a leaf, and bytes of a block's integers.
LEAF = 4
BLOCK_BYTES = 1 << 22

_TREE = "struct<order: binary, points: binary, low: binary, high: binary, total: binary>"


# Trees -----------------------------------------------------------------------
# A tree of depth L over n points: the node i of level l holds the sorted points [i * n >> l, (i + 1) * n >> l).


def _depth(points: int, leaf: int) -> int:
    """Levels below the root until at most `leaf` points are left, unless a node would be empty."""
    return min((-(-points // leaf) - 1).bit_length(), points.bit_length() - 1)


def _bounds(points: int, level: int) -> np.ndarray:
    return (np.arange((1 << level) + 1, dtype=np.int64) * points) >> level


class Tree:
    """Sorted points; per level the boxes and sums of its nodes."""

    def __init__(self, order, points, low, high, total):
        self.order, self.points, self.low, self.high, self.total = order, points, low, high, total

    @property
    def depth(self) -> int:
        return len(self.low) - 1

    @classmethod
    def build(cls, points: np.ndarray, leaf: int) -> Tree:
        n, depth = len(points), _depth(len(points), leaf)
        order = np.arange(n)
        for level in range(depth):
            bounds = _bounds(n, level)
            node = np.repeat(np.arange(1 << level), np.diff(bounds))
            placed = points[order]
            width = np.maximum.reduceat(placed, bounds[:-1]) - np.minimum.reduceat(placed, bounds[:-1])
            key = placed[np.arange(n), width.argmax(1)[node]]
            order = order[np.lexsort((key, node))]
        placed, first = points[order], _bounds(n, depth)[:-1]
        low, high, total = [np.minimum.reduceat(placed, first)], [np.maximum.reduceat(placed, first)], [np.add.reduceat(placed, first)]
        for _ in range(depth):
            low.append(np.minimum(low[-1][::2], low[-1][1::2]))
            high.append(np.maximum(high[-1][::2], high[-1][1::2]))
            total.append(total[-1][::2] + total[-1][1::2])
        return cls(order, placed, low[::-1], high[::-1], total[::-1])

    def pack(self) -> dict:
        join = lambda levels, kind: np.concatenate(levels).astype(kind).tobytes()
        return {
            "order": self.order.astype("<i4").tobytes(),
            "points": self.points.astype("<i4").tobytes(),
            "low": join(self.low, "<i4"),
            "high": join(self.high, "<i4"),
            "total": join(self.total, "<i8"),
        }

    @classmethod
    def unpack(cls, packed: dict, width: int) -> Tree:
        read = lambda name, kind: np.frombuffer(packed[name], kind).astype(np.int64)
        low, high, total = (read(n, k).reshape(-1, width) for n, k in (("low", "<i4"), ("high", "<i4"), ("total", "<i8")))
        ends = (1 << np.arange(1, len(low).bit_length())) - 1  # of the levels above the lowest
        levels = [np.split(x, ends) for x in (low, high, total)]
        return cls(read("order", "<i4"), read("points", "<i4").reshape(-1, width), *levels)


def _squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def _near_pairs(q: np.ndarray, low, high, e_low, e_high, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs (node q, entry box) remain, and every pair's largest distance."""
    gap = np.maximum(np.maximum(low - e_high, e_low - high), 0)
    far = _squares(np.maximum(high - e_low, e_high - low))
    most = np.full(nodes, np.iinfo(np.int64).max)
    np.minimum.at(most, q, far)
    return _squares(gap) <= most[q], far


def _undominated(q: np.ndarray, e: np.ndarray, far: np.ndarray, low, high, entries: np.ndarray, nodes: int) -> np.ndarray:
    """Pairs whose entry is the nearest somewhere in the node's box, as far as one rival, the entry with the
    smallest largest distance, can tell."""
    first = np.lexsort((e, far, q))
    lead = first[np.flatnonzero(np.diff(q[first], prepend=-1))]
    rival = np.empty(nodes, np.int64)
    rival[q[lead]] = e[lead]
    b = rival[q]
    step = entries[e] - entries[b]
    least = _squares(entries[e]) - _squares(entries[b]) - 2 * np.maximum(low * step, high * step).sum(1)
    return (least < 0) | ((least == 0) & (e <= b))


def assign(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entry of every point (in the points' own order), sums and counts per entry, and the number of
    points that were assigned with their node."""
    n, width = tree.points.shape
    book = Tree.build(entries, 1)
    codes = np.empty(n, np.int64)  # in the tree's order
    sums, counts = np.zeros_like(entries), np.zeros(len(entries), np.int64)
    q, e = np.zeros(1, np.int64), np.zeros(1, np.int64)
    level = e_level = whole = 0
    single = book.depth == 0
    if single:
        e = np.sort(book.order)
        q = np.zeros(len(e), np.int64)
    while len(q):
        nodes = 1 << level
        low, high = tree.low[level][q], tree.high[level][q]
        if single:
            keep, far = _near_pairs(q, low, high, entries[e], entries[e], nodes)
            q, e, far, low, high = q[keep], e[keep], far[keep], low[keep], high[keep]
            keep = _undominated(q, e, far, low, high, entries, nodes)
            q, e = q[keep], e[keep]
            rivals = np.bincount(q, minlength=nodes)
            alone = rivals[q] == 1
            bounds = _bounds(n, level)
            sizes = np.diff(bounds)[q[alone]]
            at = np.repeat(bounds[q[alone]] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            codes[at] = np.repeat(e[alone], sizes)
            np.add.at(sums, e[alone], tree.total[level][q[alone]])
            np.add.at(counts, e[alone], sizes)
            whole += int(sizes.sum())
            q, e = q[~alone], e[~alone]
            if level == tree.depth:
                _leaves(tree, q, e, entries, codes, sums, counts)
                break
        else:
            keep, _ = _near_pairs(q, low, high, book.low[e_level][e], book.high[e_level][e], nodes)
            q, e = q[keep], e[keep]
            if e_level < book.depth:
                q, e = np.repeat(q, 2), np.repeat(2 * e, 2) + np.tile([0, 1], len(e))
                e_level += 1
            else:
                # Each lowest node holds one or two entries.
                first = _bounds(len(entries), e_level)
                q = np.concatenate([q, q[first[e + 1] - first[e] > 1]])
                e = np.concatenate([book.order[first[e]], book.order[first[e + 1] - 1][first[e + 1] - first[e] > 1]])
                single = True
                continue
        if level < tree.depth:
            q, e = np.repeat(2 * q, 2) + np.tile([0, 1], len(q)), np.repeat(e, 2)
            level += 1
    out = np.empty(n, np.int64)
    out[tree.order] = codes
    return out, sums, counts, whole


def _leaves(tree: Tree, q, e, entries, codes, sums, counts) -> None:
    """Integer comparison of the points of undecided leaves with the entries left there, one entry at a time."""
    if not len(q):
        return
    by = np.lexsort((e, q))
    q, e = q[by], e[by]
    leaf, first, rivals = np.unique(q, return_index=True, return_counts=True)
    bounds = _bounds(len(tree.points), tree.depth)
    sizes = np.diff(bounds)[leaf]
    at = np.repeat(bounds[leaf] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    points, first, rivals = tree.points[at], np.repeat(first, sizes), np.repeat(rivals, sizes)
    best, code = np.full(len(at), np.iinfo(np.int64).max), np.empty(len(at), np.int64)
    for k in range(rivals.max()):
        there = np.flatnonzero(rivals > k)
        entry = e[first[there] + k]
        distance = _squares(points[there] - entries[entry])
        nearer = distance < best[there]  # entries ascend, so the first of equals stays
        best[there[nearer]], code[there[nearer]] = distance[nearer], entry[nearer]
    codes[at] = code
    np.add.at(sums, code, points)
    np.add.at(counts, code, 1)


# In a task -------------------------------------------------------------------


def _build(dim: int, parts: int, ids: pa.DataType, labels: pa.DataType):
    """Blocks of vectors with a tree per part."""
    width = dim // parts
    most = min(1 << 16, max(LEAF, BLOCK_BYTES // (4 * dim)))
    limit = int((2**63 // (4 * dim)) ** 0.5) - 1
    fields = [(n, pa.binary()) for n in ("order", "points", "low", "high", "total")]
    schema = pa.schema([("ids", pa.list_(ids)), ("labels", pa.list_(labels)), ("trees", pa.list_(pa.struct(fields)))])

    def block(table: pa.Table) -> pa.RecordBatch:
        column = table["ints"].combine_chunks()
        values = column.flatten().to_numpy(zero_copy_only=False).reshape(len(table), dim)
        if values.size and max(-int(values.min()), int(values.max())) > limit:
            raise ValueError(f"components beyond {limit} in size have squared distances that do not fit in 64 bits")
        trees = [Tree.build(values[:, p : p + width], LEAF).pack() for p in range(0, dim, width)]
        row = {"ids": table["vec_id"].to_pylist(), "labels": table["label"].to_pylist(), "trees": trees}
        return pa.RecordBatch.from_pylist([row], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            waiting.append(batch)
            rows += len(batch)
            while rows >= most:
                table = pa.Table.from_batches(waiting)
                yield block(table.slice(0, most))
                waiting, rows = table.slice(most).to_batches(), rows - most
        if rows:
            yield block(pa.Table.from_batches(waiting))

    return run


def _sum(codebooks: np.ndarray):
    """Sums and counts per part and entry over the blocks of a task; place -1 is the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = codebooks.shape
        sums, counts = np.zeros_like(codebooks), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for trees in batch["trees"]:
                for p, packed in enumerate(trees.as_py()):
                    _, more, number, _ = assign(Tree.unpack(packed, width), codebooks[p])
                    sums[p] += more
                    counts[p] += number
        p, e, k = np.indices((parts, entries, width + 1)).reshape(3, -1)
        value = np.concatenate([sums, counts[:, :, None]], axis=2).reshape(-1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(np.where(k == width, -1, k), pa.int32()), pa.array(value)],
            names=["part", "entry", "place", "value"],
        )

    return run


def _encode(codebooks: np.ndarray):
    """Code and error of every vector of a block."""
    hexed = [f"{i:02x}" for i in range(codebooks.shape[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                codes, error = [], 0
                for p, packed in enumerate(batch["trees"][i].as_py()):
                    tree = Tree.unpack(packed, codebooks.shape[2])
                    code, *_ = assign(tree, codebooks[p])
                    own = np.empty(len(code), np.int64)
                    own[tree.order] = _squares(tree.points - codebooks[p][code[tree.order]])
                    codes.append(code)
                    error = error + own
                text = ["".join([hexed[x] for x in row]) for row in np.stack(codes, axis=1)]
                yield pa.RecordBatch.from_arrays(
                    [batch["ids"][i].values, batch["labels"][i].values, pa.array(text), pa.array(error)],
                    names=["vec_id", "label", "code", "error"],
                )

    return run


# Plans -----------------------------------------------------------------------


def integers(vector: Column, scale: int = SCALE) -> Column:
    """Floor of each component times `scale`; null for a vector with a component that is no finite number."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def fit(blocks: DataFrame, first: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component) after Lloyd's rounds from `first`."""
    books = first
    for _ in range(rounds):
        sums = blocks.select("trees").mapInArrow(_sum(books), "part int, entry int, place int, value bigint")
        # entries x (dimension + parts) numbers.
        found = sums.groupBy("part", "entry", "place").agg(F.sum("value").alias("value")).collect()
        totals = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
        for r in found:
            totals[r.part, r.entry, r.place] = r.value
        counts = totals[:, :, -1:]
        books = np.where(counts > 0, totals[:, :, :-1] // np.maximum(counts, 1), books)
    return books


def compress(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    dim: int | None = None,
) -> tuple[DataFrame, np.ndarray]:
    """Per vector vec_id, label, code, error (squared distances, summed over parts) and label_error (errors
    summed over the rows of its label, null being one); and the codebooks (part, entry, component)."""
    column = lambda c: F.col(f"`{c}`")
    if entries > 256:
        raise ValueError("a code has two hexadecimal digits for an entry")
    plain = vectors.select(
        column(vec_id).alias("vec_id"), column(label).alias("label"), integers(column(vector), scale).alias("ints")
    ).filter(F.col("ints").isNotNull())
    ids, labels = plain.schema["vec_id"].dataType, plain.schema["label"].dataType
    by_id = [F.asc_nulls_last("vec_id"), F.asc("ints")]
    if dim is None:
        dim = len(row.ints) if (row := plain.orderBy(*by_id).select("ints").first()) else parts
    if dim % parts or not dim:
        raise ValueError(f"vectors of {dim} components cannot be cut into {parts} parts")
    fitting = plain.filter(F.size("ints") == dim)
    start = np.array([r.ints for r in fitting.orderBy(*by_id).limit(entries).select("ints").collect()], np.int64)
    start = start.reshape(-1, parts, dim // parts).transpose(1, 0, 2)
    kinds = f"vec_id {ids.simpleString()}, label {labels.simpleString()}, code string, error bigint"
    if not start.shape[1]:
        coded = fitting.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        books = start
    else:
        from pyspark.sql.pandas.types import to_arrow_type

        made = fitting.mapInArrow(
            _build(dim, parts, to_arrow_type(ids), to_arrow_type(labels)),
            f"ids array<{ids.simpleString()}>, labels array<{labels.simpleString()}>, trees array<{_TREE}>",
        )
        blocks = save(made, "vector-blocks")
        books = fit(blocks, start, rounds)
        coded = blocks.mapInArrow(_encode(books), kinds)
    none = F.lit(None)
    others = plain.filter(F.size("ints") != dim).select("vec_id", "label", none.cast("string").alias("code"), none.cast("long").alias("error"))
    coded = save(coded.unionByName(others), "vector-codes")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
