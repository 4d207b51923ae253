"""A manifest of a dataset as a hash tree whose parents keep the hash states between their children.

Every document is a leaf, a digest of its fields. The leaves of a group (a language, say) stand in the order of
their ids; every run of `WIDTH` nodes has a parent, the SHA-256 of their joined digests, until one node
is left, the group's root. Group roots, in the order of the groups, have parents in the same way up to
the root of the dataset.

While a parent is hashed, the state before each child is copied and kept (`midstate`: eight words, because a
child's text is one block). Folding a changed child resumes the state kept before it, with the
replacement and the siblings to its right; nothing to its left is hashed again.

The tree is built in steps of `LEVELS` levels. A step takes the nodes in chunks of WIDTH ** LEVELS, one chunk
in one task at a time, and writes one row per chunk: the digests and states of its levels. That table is the
manifest; the chunks' own digests are the nodes of the next step, so a billion leaves take three steps. On the
way down each chunk learns the path above it, and the leaves meet their chunk to be proved and folded. A group
of any size spreads over its chunks; one number, the size of the largest group, reaches the driver.

Rows: a null field is `-`, an empty text `0:`, a text of any length is hashed in place and never shuffled; a null
group comes first and is a group; null ids come first within their group; rows of one id stand in the
order of their digests, and rows that repeat are leaves of their own; an empty table gives an empty result. Only
the columns named are read, whatever others the table has.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.numbering import range_positions
from . import midstate
from .common import save

WIDTH = 8
#: Levels of a step: WIDTH ** LEVELS nodes, 4,096 digests, are in a task at once.
LEVELS = 4

_LEVEL = "struct<digests: binary, states: binary>"
_MANIFEST = f"tree string, step int, chunk bigint, nodes bigint, digest binary, levels array<{_LEVEL}>"
_STEP = "struct<slot: int, count: int, siblings: binary, state: binary>"


def field_text(column: Column) -> Column:
    """`-` for null, else the byte count, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    """Digest of a document's fields, as bytes."""
    return F.unhex(F.sha2(F.concat(*[field_text(f) for f in fields]), 256))


# In a task -------------------------------------------------------------------


def _parents(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parents of a level, and the state before each of its nodes."""
    runs = -(-len(digests) // WIDTH)
    state = np.tile(midstate.START, (runs, 1))
    before = np.empty_like(digests)
    for slot in range(WIDTH):
        children = digests[slot::WIDTH]
        before[slot::WIDTH] = state[: len(children)]
        state[: len(children)] = midstate.resume(state[: len(children)], midstate.hex_block(children))
    return midstate.finish(state, _counts(len(digests))), before


def _counts(nodes: int) -> np.ndarray:
    """Children of each parent of a level."""
    first = np.arange(0, nodes, WIDTH)
    return np.minimum(WIDTH, nodes - first).astype(np.uint32)


def _subtree(digests: np.ndarray, alone: bool, height: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Top of a chunk and its levels. A chunk that is its whole tree ends where one node is left; one
    of several goes up all levels, even with one node."""
    levels = []
    while (len(digests) > 1) if alone else (len(levels) < height):
        above, before = _parents(digests)
        levels.append((digests, before))
        digests = above
    return digests, levels


def _build(step: int, height: int):
    chunk = WIDTH**height

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        digests = midstate.words(b"".join(table["digest"].to_pylist()))
        nodes = table["total"][0].as_py()
        top, levels = _subtree(digests, nodes <= chunk, height)
        row = {
            "tree": table["tree"][0].as_py(),
            "step": step,
            "chunk": table["chunk"][0].as_py(),
            "nodes": -(-nodes // chunk),
            "digest": midstate.raw(top),
            "levels": [{"digests": midstate.raw(d), "states": midstate.raw(s)} for d, s in levels],
        }
        kinds = [("digests", pa.binary()), ("states", pa.binary())]
        return pa.Table.from_pylist(
            [row],
            pa.schema(
                [
                    ("tree", pa.string()),
                    ("step", pa.int32()),
                    ("chunk", pa.int64()),
                    ("nodes", pa.int64()),
                    ("digest", pa.binary()),
                    ("levels", pa.list_(pa.struct(kinds))),
                ]
            ),
        )

    return run


def _levels(row: dict) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(midstate.words(x["digests"]), midstate.words(x["states"])) for x in row["levels"]]


def _down(height: int):
    """Per node of a chunk: its way up, first within the chunk and then as the chunk's."""

    def way(levels, node: int) -> list[dict]:
        path = []
        for digests, states in levels:
            first = node - node % WIDTH
            run = digests[first : first + WIDTH]
            others = midstate.raw(np.delete(run, node - first, axis=0))
            path.append({"slot": node - first, "count": len(run), "siblings": others, "state": midstate.raw(states[node])})
            node //= WIDTH
        return path

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                levels = _levels(row)
                same = {c: row[c] for c in ("tree", "subroot", "root")}
                first = row["chunk"] * WIDTH**height
                nodes = range(len(levels[0][0]) if levels else 1)
                out = [same | {"chunk": first + i, "path": way(levels, i) + row["path"]} for i in nodes]
                yield pa.RecordBatch.from_pylist(out, _path_schema())

    return run


def _path_schema() -> pa.Schema:
    step = [("slot", pa.int32()), ("count", pa.int32()), ("siblings", pa.binary()), ("state", pa.binary())]
    return pa.schema(
        [
            ("tree", pa.string()),
            ("chunk", pa.int64()),
            ("path", pa.list_(pa.struct(step))),
            ("subroot", pa.binary()),
            ("root", pa.binary()),
        ]
    )


def _proofs(levels: list[tuple[np.ndarray, np.ndarray]], above: bytes) -> list[bytes]:
    """Per node, the texts of its siblings from its own level to the root. A parent's are shared by its children."""
    known = [above]
    for digests, _ in reversed(levels):
        written = midstate.texts(digests)
        runs = [b"".join(written[i : i + WIDTH]) for i in range(0, len(written), WIDTH)]
        known = [
            runs[i // WIDTH][: 64 * (i % WIDTH)] + runs[i // WIDTH][64 * (i % WIDTH + 1) :] + known[i // WIDTH]
            for i in range(len(written))
        ]
    return known


def _fold(now: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], path: list[dict]) -> np.ndarray:
    """Roots that follow from replacing, one at a time, each node of the chunk by its row of `now`."""
    at = np.arange(len(now))
    for digests, states in levels:
        state = midstate.resume(states[at], midstate.hex_block(now))
        for further in range(1, WIDTH):
            right = at + further
            there = np.flatnonzero((right < len(digests)) & (right // WIDTH == at // WIDTH))
            state[there] = midstate.resume(state[there], midstate.hex_block(digests[right[there]]))
        now = midstate.finish(state, _counts(len(digests))[at // WIDTH])
        at = at // WIDTH
    for step in path:
        state = midstate.resume(np.tile(midstate.words(step["state"]), (len(now), 1)), midstate.hex_block(now))
        for sibling in midstate.words(step["siblings"])[step["slot"] :]:
            block = np.tile(midstate.hex_block(sibling[None]), (len(now), 1))
            state = midstate.resume(state, block)
        now = midstate.finish(state, np.full(len(now), step["count"], np.uint32))
    return now


def _answer(leaves: pa.Table, chunk: pa.Table) -> pa.Table:
    leaves = leaves.sort_by("idx")
    (row,) = chunk.to_pylist()
    levels = _levels(row)
    above = b"".join(b"".join(midstate.texts(midstate.words(s["siblings"]))) for s in row["path"])
    folded = _fold(midstate.words(b"".join(leaves["claimed"].to_pylist())), levels, row["path"])
    plain = lambda raw: pa.array([raw.hex()] * len(leaves), pa.string())
    columns = {
        "doc_id": leaves["doc_id"],
        "leaf": pa.array([x.hex() for x in leaves["digest"].to_pylist()], pa.string()),
        "subroot": plain(row["subroot"]),
        "root": plain(row["root"]),
        "proof_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in _proofs(levels, above)], pa.string()),
        "folded_root": pa.array([x.decode() for x in midstate.texts(folded)], pa.string()),
    }
    return pa.table(columns)


# Plans -----------------------------------------------------------------------


def _climb(nodes: DataFrame, name: str, height: int) -> list[DataFrame]:
    """The manifest of each step over nodes (tree, idx, total, digest), the last with one chunk per tree."""
    chunk = WIDTH**height
    largest = nodes.agg(F.max("total")).first()[0] or 0
    steps: list[DataFrame] = []
    while True:
        chunked = nodes.withColumn("chunk", F.expr(f"idx div {chunk}"))
        built = chunked.groupBy("tree", "chunk").applyInArrow(_build(len(steps), height), _MANIFEST)
        steps.append(save(built, f"manifest-{name}"))
        largest = -(-largest // chunk)
        if largest <= 1:
            return steps
        nodes = steps[-1].select("tree", F.col("chunk").alias("idx"), F.col("nodes").alias("total"), "digest")


def _descend(steps: list[DataFrame], paths: DataFrame, height: int) -> DataFrame:
    """Paths (tree, chunk, path, subroot, root) of the nodes of the first of some steps, `chunk` being a node's
    number, from the paths of the chunks of the last."""
    kind = f"tree string, chunk bigint, path array<{_STEP}>, subroot binary, root binary"
    for step in reversed(steps):
        met = step.select("tree", "chunk", "levels").join(paths, ["tree", "chunk"])
        paths = met.mapInArrow(_down(height), kind)
    return paths


def manifest(
    docs: DataFrame,
    fields: list[Column],
    group: Column,
    claimed: Column | None = None,
    doc_id: str = "doc_id",
    height: int = LEVELS,
) -> tuple[DataFrame, list[DataFrame]]:
    """The documents with their proofs, and the tables of the tree.

    Per document: doc_id, leaf, subroot, root, proof_sha256 (of the siblings' texts on the way up), folded_root
    (the root that follows when the leaf is replaced by `claimed`, bytes made with `leaf`; null or none given
    keeps the leaf) and verified (the two roots are equal). The tables are the steps of the groups' trees
    and then those of the tree over group roots, one row per chunk with the digests and states of its levels."""
    own = leaf(*fields)
    tree = F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))  # null first, then by bytes
    other = F.lit(None).cast("binary") if claimed is None else claimed
    narrow = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), tree.alias("tree"), own.alias("digest"), other.alias("claimed")
    )
    narrow = save(narrow.withColumn("claimed", F.coalesce("claimed", "digest")), "leaves")
    leaves = range_positions(narrow, ["doc_id", "digest"], "idx", within=["tree"], total="total")
    leaves = save(leaves, "leaves-numbered")
    groups = _climb(leaves.select("tree", "idx", "total", "digest"), "groups", height)
    subroots = groups[-1].select(F.col("tree").alias("group"), "digest")
    above = range_positions(subroots, ["group"], "idx", total="total")
    above = save(above.withColumn("tree", F.lit("")), "subroots")
    tops = _climb(above.select("tree", "idx", "total", "digest"), "root", height)

    nothing = F.array().cast(f"array<{_STEP}>").alias("path")
    none = F.lit(None).cast("binary").alias("subroot")
    top = tops[-1].select("tree", "chunk", nothing, none, F.col("digest").alias("root"))
    # One path per group root: its way through the tree over groups.
    root_paths = _descend(tops, top, height).join(above, F.col("chunk") == F.col("idx"))
    group_paths = root_paths.select(
        F.col("group").alias("tree"), F.lit(0).cast("long").alias("chunk"), "path", F.col("digest").alias("subroot"), "root"
    )
    chunks = groups[0].select("tree", "chunk", "levels").join(_descend(groups[1:], group_paths, height), ["tree", "chunk"])
    kind = docs.schema[doc_id].dataType.simpleString()
    columns = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    placed = leaves.withColumn("chunk", F.expr(f"idx div {WIDTH**height}"))
    proved = (
        placed.groupBy("tree", "chunk")
        .cogroup(chunks.groupBy("tree", "chunk"))
        .applyInArrow(_answer, f"doc_id {kind}, " + ", ".join(f"{c} string" for c in columns))
    )
    return proved.withColumn("verified", F.col("folded_root") == F.col("root")), [*groups, *tops]
