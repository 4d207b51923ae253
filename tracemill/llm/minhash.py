"""MinHash near-duplicates with circulant signatures.

Two permutations of 32-bit integers serve all coordinates: the first places a shingle on a circle, the
second ranks the places after the circle was turned by k steps for coordinate k. Signatures are cut
into bands; documents whose sets share a band are candidates, and links are confirmed on full sets.

Documents with equal sets are one node from the start. Within a bucket nobody is compared with all others
at once: first each member meets the bucket's centre, and what links becomes one component. Most buckets
are then done. Of the others, small ones compare members of different components pair by pair; in large
ones the members form a cluster, cut into blocks, and two blocks meet in a task that counts overlaps by
matrix products and returns only links that join components. No candidate is dropped, no pair list of a
group is ever written, and a bucket that holds a third of all documents is spread over tasks.

Nulls and edges: a text without words, or null, has an empty set and links with nothing; a null id is
the last choice for representing its group; rows that repeat are members of one group. A text's set is built and
compared whole, whatever its length; an empty table gives an empty result. Only the named columns are read;
rows that are kept keep all their columns, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textscan
from .common import SPACES, row_key, save, whole_row

SHINGLE = 4
PERCENT = 80
BANDS = 40
ROWS = 6  # a pair at 0.8 shares none of the bands with probability 5e-6
CHUNK = 64  # pairs that meet one copy of a centre
SMALL = 64  # members of a bucket up to which its pairs are rows
BLOCK = 256  # sets of a block of a cluster, and of a tile that is compared at once
TILE = 64

_SIGNATURE = "key struct<a:bigint,b:bigint>, doc_id {id}, n_shingles bigint, node binary, bands array<bigint>"
_U32 = np.uint32


def _permute(x: np.ndarray, a: int, b: int, shifts: tuple[int, int, int]) -> np.ndarray:
    """In place: a bijection of 32-bit integers, made of shifts and odd factors."""
    x ^= x >> _U32(shifts[0])
    x *= _U32(a)
    x ^= x >> _U32(shifts[1])
    x *= _U32(b)
    x ^= x >> _U32(shifts[2])
    return x


def signatures(sets: np.ndarray, starts: np.ndarray, coordinates: int) -> np.ndarray:
    """Coordinates x sets: minima over each (non-empty) set of the turned second permutation."""
    places = _permute((sets ^ (sets >> np.uint64(32))).astype(_U32), 0x7FEB352D, 0x846CA68B, (16, 15, 16))
    out = np.empty((coordinates, len(starts)), _U32)
    turned = np.empty_like(places)
    for k in range(coordinates):
        np.subtract(places, _U32(k), out=turned)
        np.minimum.reduceat(_permute(turned, 0x85EBCA6B, 0xC2B2AE35, (16, 13, 16)), starts, out=out[k])
    return out


def band_hashes(signature: np.ndarray, rows: int) -> np.ndarray:
    """Sets x bands: one 64-bit hash per band, different for equal values in different bands."""
    bands = signature.reshape(-1, rows, signature.shape[1]).astype(np.uint64)
    out = np.arange(len(bands), dtype=np.uint64)[:, None] + np.zeros((1, signature.shape[1]), np.uint64)
    for r in range(rows):
        out = textscan.mix((out << np.uint64(1)) ^ (bands[:, r] * np.uint64(2 * r + 1) + np.uint64(r + 1)))
    return out.T.view(np.int64)


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) over runs of rows."""
    lower, gaps = textscan.lower_table(), textscan.space_table()
    for first, last, data, offsets in textscan.text_runs(column):
        starts, ends, at = textscan.word_bounds(data, offsets, gaps)
        words = textscan.word_hashes(lower[data], starts, ends)
        sets = []
        for i in range(last - first):
            own = words[at[i] : at[i + 1]]
            sets.append(np.unique(textscan.gram_hashes(own, min(size, len(own)))) if len(own) else own)
        yield first, sets


def _signed(size: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            nodes, counts, offsets, values = [], [], [np.zeros(1, np.int32)], []
            for _, sets in shingle_sets(batch["text"], size):
                lengths = np.array([len(s) for s in sets])
                counts.append(lengths)
                nodes += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                full = np.flatnonzero(lengths)
                if len(full):
                    starts = np.cumsum(lengths[full]) - lengths[full]
                    made = band_hashes(signatures(np.concatenate([sets[i] for i in full]), starts, bands * rows), rows)
                    values.append(made.reshape(-1))
                offsets.append(offsets[-1][-1] + np.cumsum((lengths > 0) * bands, dtype=np.int32))
            if not len(batch):
                continue
            flat = pa.array(np.concatenate(values) if values else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["key"],
                    batch["doc_id"],
                    pa.array(np.concatenate(counts).astype(np.int64)),
                    pa.array(nodes, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate(offsets)), flat),
                ],
                names=["key", "doc_id", "n_shingles", "node", "bands"],
            )

    return run


def sign(docs: DataFrame, doc_id: str, text: str, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: key, doc_id, n_shingles, node (digest of its set, null if empty) and its band hashes."""
    plain = docs.select(row_key(doc_id, text).alias("key"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(_signed(size, bands, rows), _SIGNATURE.format(id=kind))


def _sets_of(size: int):
    def run(batches):
        for batch in batches:
            for first, sets in shingle_sets(batch["text"], size):
                yield pa.RecordBatch.from_arrays(
                    [batch["node"].slice(first, len(sets)), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    names=["node", "items"],
                )

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (u, v) whose sets overlap enough. Copies of v's set grow with the pairs it is in."""
    copies = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("bigint").alias("copies"))
    dealt = pairs.join(copies, "v").withColumn("copy", F.pmod(F.xxhash64("u"), F.col("copies")))
    left = sets.select(F.col("node").alias("u"), F.col("items").alias("u_items"))
    right = sets.select(F.col("node").alias("v"), F.col("items").alias("v_items")).join(copies, "v")
    right = right.select("v", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy"), "v_items")
    met = dealt.join(right, ["v", "copy"]).join(left, "u")
    both = F.size(F.array_intersect("u_items", "v_items"))
    return met.filter(both * 100 >= (F.size("u_items") + F.size("v_items") - both) * percent).select("u", "v")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of an edge: alternating large and small stars, each a few joins and
    groupings over edges; a node with very many neighbours is only ever reduced to its minimum."""

    def state(e: DataFrame) -> tuple:
        # Numbers of edges and a sum of their hashes: one row, to see whether a round changed anything.
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = save(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), name
    )
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = save(large.filter("u <> v").distinct(), name)
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        edges = save(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(),
            name,
        )
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _stars(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bucket, centre) and (u, v): each member of a bucket with its centre. The centre is the member
    that shares the most: it is likely to be the text from which the others were made."""
    scores = members.groupBy("node").agg(F.sum("size").alias("score"))
    scored = members.join(scores, "node")
    centres = scored.groupBy("bucket").agg(F.max(F.struct("score", "node"))["node"].alias("centre"))
    met = members.join(centres, "bucket").filter("node <> centre")
    return centres, met.select(F.col("node").alias("u"), F.col("centre").alias("v")).distinct()


def _small_pairs(active: DataFrame) -> DataFrame:
    """Pairs of different components in buckets of at most SMALL members."""
    small = active.filter(F.col("size") <= SMALL)
    left = small.select("bucket", F.col("node").alias("u"), F.col("root").alias("u_root"))
    right = small.select("bucket", F.col("node").alias("v"), F.col("root").alias("v_root"))
    return left.join(right, "bucket").filter("u > v and u_root <> v_root").select("u", "v").distinct()


def _spanning(u: np.ndarray, v: np.ndarray, group: np.ndarray) -> list[int]:
    """Which of the links (u, v) join different groups when taken in turn."""
    parent = {int(g): int(g) for g in group}

    def find(g: int) -> int:
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    out = []
    for i, (a, b) in enumerate(zip(u.tolist(), v.tolist())):
        a, b = find(int(group[a])), find(int(group[b]))
        if a != b:
            parent[a] = b
            out.append(i)
    return out


def block_links(sets: list[np.ndarray], groups: np.ndarray, first: int, percent: int) -> list[tuple[int, int]]:
    """Links between sets[:first] and the rest (or among all, if first is all of them) that join different
    groups. Overlaps are counted by products of incidence matrices, a tile of sets by a tile."""
    sizes = np.array([len(s) for s in sets])
    same = first == len(sets)
    found_u, found_v = [], []
    for a in range(0, first, TILE):
        ours = range(a, min(a + TILE, first))
        words = np.unique(np.concatenate([sets[i] for i in ours]))
        for b in range(a if same else first, len(sets), TILE):
            others = range(b, min(b + TILE, len(sets)))
            common = np.intersect1d(words, np.unique(np.concatenate([sets[i] for i in others])), assume_unique=True)
            if not len(common):
                continue

            def incidence(tile, common=common):
                out = np.zeros((len(tile), len(common)), np.float32)
                for k, i in enumerate(tile):
                    at = np.searchsorted(common, sets[i])
                    at[at == len(common)] = 0
                    out[k, at[common[at] == sets[i]]] = 1
                return out

            both = incidence(ours) @ incidence(others).T
            union = sizes[list(ours)][:, None] + sizes[list(others)][None, :] - both
            u, v = np.nonzero(both * 100 >= union * percent)
            u, v = u + a, v + b
            apart = groups[u] != groups[v]
            found_u.append(u[apart])
            found_v.append(v[apart])
    if not found_u:
        return []
    u, v = np.concatenate(found_u), np.concatenate(found_v)
    return [(int(u[i]), int(v[i])) for i in _spanning(u, v, groups)]


def _compared(percent: int):
    def run(batches):
        for batch in batches:
            for row in batch.select(["mine", "theirs"]).to_pylist():
                mine, theirs = row["mine"], row["theirs"] or []
                every = mine + theirs
                sets = [np.array(m["items"], np.int64) for m in every]
                names = {root: k for k, root in enumerate({m["root"] for m in every})}
                groups = np.array([names[m["root"]] for m in every])
                links = block_links(sets, groups, len(mine), percent)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([every[pair[side]]["node"] for pair in links], pa.binary()) for side in (0, 1)],
                    names=["u", "v"],
                )

    return run


def _dense_links(active: DataFrame, centres: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components in buckets of more than SMALL members. The sets that such buckets connect
    are a cluster; it is cut into blocks of about BLOCK sets, and each two blocks meet once, in a task
    of their own, however many buckets they share. Only links that join components come out."""
    dense = active.filter(F.col("size") > SMALL)
    edges = dense.join(centres, "bucket").select(F.col("node").alias("u"), F.col("centre").alias("v"))
    clusters = components(edges, "clusters").withColumnRenamed("root", "cluster")
    clusters = clusters.unionByName(clusters.select(F.col("cluster").alias("node"), "cluster").distinct())
    roots = dense.select("node", "root").distinct()
    inside = clusters.join(roots, "node")
    sized = inside.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("bigint").alias("blocks"))
    inside = inside.join(sized, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    held = inside.join(sets, "node").groupBy("cluster", "block", "blocks").agg(
        F.collect_list(F.struct("node", "root", "items")).alias("members"), F.count_distinct("root").alias("n_roots"),
        F.min("root").alias("any_root"),
    )
    held = save(held, "blocks")
    left = held.select("cluster", F.col("block").alias("i"), "blocks", F.col("members").alias("mine"), F.col("n_roots").alias("a"), F.col("any_root").alias("x"))
    left = left.withColumn("j", F.explode(F.sequence(F.col("i"), F.col("blocks") - 1)))
    right = held.select("cluster", F.col("block").alias("j"), F.col("members").alias("theirs"), F.col("n_roots").alias("b"), F.col("any_root").alias("y"))
    met = left.join(right, ["cluster", "j"]).filter("a > 1 or b > 1 or x <> y")
    met = met.select("mine", F.when(F.col("i") < F.col("j"), F.col("theirs")).alias("theirs"))
    return met.mapInArrow(_compared(percent), "u binary, v binary")


def link_components(signed: DataFrame, docs: DataFrame, doc_id: str, text: str, size: int, percent: int) -> DataFrame:
    """(node, root) of the sets that link with other sets."""
    nodes = signed.filter("n_shingles > 0").groupBy("node").agg(F.first("bands").alias("bands"), F.min("key").alias("key"))
    nodes = save(nodes, "nodes")
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = save(rows.join(shared, "bucket"), "members")
    wanted = nodes.select("node", "key").join(members.select("node").distinct(), "node")
    texts = docs.select(row_key(doc_id, text).alias("key"), F.col(text).alias("text")).join(wanted, "key")
    sets = save(texts.select("node", "text").mapInArrow(_sets_of(size), "node binary, items array<bigint>"), "sets")
    sets = sets.groupBy("node").agg(F.first("items").alias("items")) if _repeats(sets) else sets
    centres, pairs = _stars(members)
    centres = save(centres, "centres")
    links = save(confirmed(save(pairs, "star-pairs"), sets, percent), "star-links")
    roots = components(links, "star-components")
    labelled = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = labelled.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b")
    active = save(labelled.join(mixed.select("bucket"), "bucket"), "active")
    pairs = save(_small_pairs(active), "small-pairs")
    links = links.unionByName(save(confirmed(pairs, sets, percent), "small-links"))
    links = links.unionByName(save(_dense_links(active, centres, sets, percent), "dense-links"))
    return components(links, "components")


def _repeats(sets: DataFrame) -> bool:
    """Whether rows that repeat in the input brought a set in twice."""
    return not sets.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """Per row: key, doc_id, n_shingles, node, root (of its component; null for an empty set) and
    component_id, the smallest id of the component."""
    signed = save(sign(docs, doc_id, text, size), "signatures")
    roots = save(link_components(signed, docs, doc_id, text, size, percent), "roots")
    signed = signed.drop("bands")
    per_node = signed.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    groups = per_node.join(roots, "node", "left").withColumn("linked", F.col("root").isNotNull())
    groups = save(groups.withColumn("root", F.coalesce("root", "node")), "groups")
    # Roots are no nodes of `roots` themselves; they belong to a group all the same.
    lows = groups.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("copies").alias("copies")).filter("copies > 1")
    known = save(groups.select("node", "root").join(lows.select("root", "component_id"), "root"), "known")
    out = signed.join(known, "node", "left")
    return out.select(
        "key",
        "doc_id",
        "n_shingles",
        "node",
        F.coalesce("root", "node").alias("root"),
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns. Documents
    without words belong to no group and stay."""
    found = near_duplicates(docs, doc_id, text, size, percent).filter("root is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key"))["key"]
    chosen = save(found.groupBy("root").agg(first.alias("__m_key")).select("__m_key").distinct(), "chosen")
    whole = docs.select(whole_row(docs).alias("row"), row_key(doc_id, text).alias("__m_key"))
    blank = F.btrim(F.coalesce(F.col("row")[text], F.lit("")), F.lit(SPACES)) == ""
    first_rows = whole.filter(~blank).join(chosen, "__m_key", "left_semi").dropDuplicates(["__m_key"])
    return first_rows.unionByName(whole.filter(blank)).select("row.*")
