"""Hash trees over documents and shards, and trees over vectors: brute force, odd rows, small cases."""

import hashlib
import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import codebooks, merkle, midstate, sharding

# Hash states -------------------------------------------------------------------------------------


def test_states_resume_to_the_usual_digests():
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(20)]
    words = midstate.words(b"".join(digests))
    assert midstate.texts(words) == [d.hex().encode() for d in digests] and midstate.raw(words) == b"".join(digests)
    for count in (1, 2, 8):
        state = midstate.START[None]
        for k in range(count):
            state = midstate.resume(state, midstate.hex_block(words[k : k + 1]))
        expected = hashlib.sha256(b"".join(d.hex().encode() for d in digests[:count])).hexdigest()
        assert midstate.texts(midstate.finish(state, np.array([count], np.uint32))) == [expected.encode()]


# Manifest ----------------------------------------------------------------------------------------


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes):
    """Levels of a tree, and per first node the siblings left and right of it on its way up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    ways = []
    for at in range(len(nodes)):
        way = []
        for level in levels[:-1]:
            run = at - at % 8
            way.append((level[run:at], level[at + 1 : run + 8]))
            at //= 8
        ways.append(way)
    return levels[-1][0], ways


def leaf_of(row):
    texts = ["-" if x is None else f"{len(str(x).encode())}:{x}" for x in row]
    return h(texts)


def expected_manifest(rows, claim):
    """Rows (doc_id, text, lang): leaf, subroot, root, proof, folded root of each, sorted."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], leaf_of(r), r))
    ordered = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for g in ordered}
    tops = {g: climb([leaf for _, leaf, _ in trees[g]]) for g in ordered}
    root, root_ways = climb([tops[g][0] for g in ordered])
    out = []
    for g, above in zip(ordered, root_ways):
        for (i, leaf, row), way in zip(trees[g], tops[g][1]):
            whole, now = [*way, *above], leaf_of(claim(row))
            for left, right in whole:
                now = h([*left, now, *right])
            out.append((i or -1, leaf, tops[g][0], root, h([*itertools.chain(*[x + y for x, y in whole])]), now, now == root))
    return sorted(out)


def prove(df, height):
    fields = [F.col("doc_id"), F.col("text"), F.col("lang")]
    claimed = merkle.leaf(F.col("doc_id"), F.lower("text"), F.col("lang"))
    proved, tables = merkle.manifest(df, fields, F.col("lang"), claimed, height=height)
    return sorted((r.doc_id or -1, *r[1:]) for r in proved.collect()), tables


def claim(row):
    return row[0], row[1] and row[1].lower(), row[2]


@pytest.mark.parametrize(("rows", "height"), [(1, 4), (8, 4), (9, 1), (73, 1), (600, 2), (600, 4)])
def test_manifest_is_the_tree(spark, rows, height):
    data = [(i, f"Text {i}" if i % 3 else f"text {i}", None if i % 5 == 0 and rows > 8 else f"l{(i * i) % 11 if rows > 9 else 0}") for i in range(rows)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string").repartition(3)
    got, tables = prove(df, height)
    assert got == expected_manifest(data, claim)
    assert {x[-1] for x in got} == ({True, False} if rows > 1 else {True})
    states = [len(x.states) // 32 for t in tables for r in t.collect() for x in r.levels]
    assert sum(states) >= (rows if rows > 11 else 0)


def test_manifest_of_odd_rows(make_docs, odd_rows):
    got, _ = prove(make_docs(odd_rows), 1)
    assert got == expected_manifest([(i, t, g) for i, t, g, _ in odd_rows], claim)
    assert prove(make_docs([]), 1)[0] == []


# Sharding ----------------------------------------------------------------------------------------


def shards_of(df, tree):
    return dict(sharding.assign(df, "id", tree).select("id", "shard").collect())


def test_a_shard_more_takes_rows_only_into_itself(spark):
    ids, tree = spark.range(6000), sharding.Tree.even(24)
    for _ in range(2):
        before, after = shards_of(ids, tree), shards_of(ids, tree.with_shard())
        new = tree.with_shard().shards[-1].shard
        assert all(after[i] in (before[i], new) for i in before)
        moved = sum(after[i] == new for i in before)
        assert abs(moved - 6000 / (new + 1)) < 5 * (6000 / (new + 1)) ** 0.5
        sizes = np.bincount(list(after.values()))
        assert len(sizes) == new + 1 and abs(sizes - 6000 / (new + 1)).max() < 5 * (6000 / (new + 1)) ** 0.5
        tree = tree.with_shard()


@pytest.mark.parametrize("weight", [0.0, 0.25, 3.0])
def test_movement_stays_in_subtrees_whose_weight_changed(spark, weight):
    ids, tree = spark.range(6000), sharding.Tree.even(24)
    changed = tree.with_weight(5, weight)
    before, after = shards_of(ids, tree), shards_of(ids, changed)
    place = {s.shard: (s.region, s.rack) for s in tree.shards}
    for i, a in before.items():
        b = after[i]
        if a == b:
            continue
        assert place[5][0] in (place[a][0], place[b][0])  # region by region: the changed one gives or takes
        if place[a][0] == place[b][0]:
            assert place[5][1] in (place[a][1], place[b][1])
        if place[a] == place[b]:
            assert 5 in (a, b)
    share = weight / (23 + weight)
    assert abs(sum(b == 5 for b in after.values()) - 6000 * share) < 5 * (6000 * share + 1) ** 0.5
    assert sum(after[i] != before[i] for i in before) > 0


def test_weights_set_the_shares(spark):
    tree = sharding.Tree(tuple(sharding.Shard(i, f"r{i % 2}", f"k{i % 3}", 1.0 + i) for i in range(6)))
    sizes = np.bincount(list(shards_of(spark.range(8000), tree).values()), minlength=6)
    expected = 8000 * np.arange(1, 7) / 21
    assert (abs(sizes - expected) < 5 * expected**0.5).all()
    with pytest.raises(ValueError):
        sharding.Tree(())
    with pytest.raises(ValueError):
        tree.with_weight(0, -1.0)


def test_shards_of_odd_rows(make_docs, odd_rows):
    got = sharding.shard_documents(make_docs(odd_rows), sharding.Tree.even(24)).collect()
    bytes_of = lambda t: (t or "").encode()
    expected = sorted((-1 if i is None else i, len(bytes_of(t)) + 8, zlib.crc32(bytes_of(t))) for i, t, _, _ in odd_rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in got) == expected
    for key in {r.doc_id for r in got}:
        assert len({(r.shard, r.grown_shard) for r in got if r.doc_id == key}) == 1
    for shard in {r.shard for r in got}:
        own = sorted(r.slot for r in got if r.shard == shard)
        assert own == list(range(len(own)))
    assert {r.law for r in got} == {"key"} and all(r.grown_shard in (r.shard, 24) for r in got)
    assert sharding.shard_documents(make_docs([]), sharding.Tree.even(24)).collect() == []


# Vector codes ------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("points", "entries", "width", "spread"),
    [(1, 1, 4, 5), (5, 3, 2, 3), (17, 64, 4, 4), (2000, 64, 4, 30), (2000, 63, 1, 9), (900, 50, 4, 0), (3000, 2, 1, 1), (800, 40, 9, 80)],
)
def test_both_trees_find_the_nearest_entry(points, entries, width, spread):
    random = np.random.default_rng(points + entries)
    x, e = (np.round(random.normal(size=(n, width)) * spread).astype(np.int64) for n in (points, entries))
    tree = codebooks.Tree.unpack(codebooks.Tree.build(x, codebooks.LEAF).pack(), width)
    codes, sums, counts, whole = codebooks.assign(tree, e)
    nearest = ((x[:, None] - e[None]) ** 2).sum(2).argmin(1)
    assert (codes == nearest).all() and (counts == np.bincount(nearest, minlength=entries)).all()
    added = np.zeros_like(e)
    np.add.at(added, nearest, x)
    assert (sums == added).all() and whole <= points
    if spread <= 1:
        assert whole > points / 2  # whole nodes go by their cached sums


def test_a_fine_cloud_is_assigned_mostly_by_nodes():
    x = np.random.default_rng(2).integers(-400, 400, (40_000, 2))
    e = np.array([(a, b) for a in range(-300, 400, 200) for b in range(-300, 400, 200)])
    *_, whole = codebooks.assign(codebooks.Tree.build(x, codebooks.LEAF), e)
    assert whole > 0.8 * len(x)


def lloyd(rows, parts, entries, rounds, scale):
    """Brute force over (id, label, vector): codes, errors, label errors and codebooks."""
    good = [r for r in rows if r[2] is not None and all(v is not None and np.isfinite(v) for v in r[2])]
    z = np.floor(np.array([r[2] for r in good], float) * scale).astype(np.int64).reshape(len(good), parts, -1)
    order = sorted(range(len(good)), key=lambda i: (good[i][0] is None, good[i][0] or 0, z[i].reshape(-1).tolist()))
    books = z[order[:entries]].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        d = ((z[:, :, None] - books[None]) ** 2).sum(3)
        code, error = d.argmin(2), d.min(2).sum(1)
        for p, e in itertools.product(range(parts), range(books.shape[1])) if turn < rounds else ():
            own = z[code[:, p] == e, p]
            if len(own):
                books[p, e] = own.sum(0) // len(own)
    total = {}
    for r, x in zip(good, error):
        total[r[1]] = total.get(r[1], 0) + int(x)
    out = [(-1 if r[0] is None else r[0], "".join(f"{c:02x}" for c in row), int(x), total[r[1]]) for r, row, x in zip(good, code, error)]
    return sorted(out), books


VECTORS = "vec_id bigint, embedding array<float>, label int, ids string, code int, error string, of int, ints int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, g, "x", 1, "y", 2, 3) for i, g, v in rows], VECTORS)


def coded(df, **how):
    got, books = codebooks.compress(df, **how)
    return sorted((-1 if r.vec_id is None else r.vec_id, r.code, r.error, r.label_error) for r in got.collect()), books


def test_codes_against_brute_force(spark, monkeypatch):
    random = np.random.default_rng(5)
    rows = [(int(i), [None, 1, 1, 2][i % 4], [float(np.float32(x)) for x in random.normal(size=8) * 0.2]) for i in random.permutation(700)]
    rows += [(3, 2, rows[0][2]), rows[1], (None, 1, rows[2][2])]
    bad = [(900, 1, None), (901, 1, [None] * 8), (902, 1, [0.0] * 7 + [float("nan")]), (903, 1, [float("inf")] + [0.0] * 7)]
    monkeypatch.setattr(codebooks, "BLOCK_BYTES", 4 * 8 * 100)  # several blocks
    got, books = coded(vectors(spark, rows + bad).repartition(3), parts=4, entries=20, rounds=3, scale=100)
    expected, expected_books = lloyd(rows + bad, 4, 20, 3, 100)
    assert got == expected and (books == expected_books).all()
    assert codebooks.digest(books) == hashlib.sha256(",".join(map(str, expected_books.reshape(-1))).encode()).hexdigest()


def test_codes_of_odd_rows(spark):
    v = [0.5] * 16
    got, books = coded(vectors(spark, [(1, 1, v), (1, 1, v), (2, None, [1.0] * 16), (3, None, []), (4, 1, [1.0] * 5), (5, 2, None)]))
    assert got == [(1, "00" * 16, 0, 0), (1, "00" * 16, 0, 0), (2, "02" * 16, 0, 0), (3, None, None, 0), (4, None, None, 0)]
    assert books.shape == (16, 3, 1)
    assert coded(vectors(spark, []))[0] == [] and coded(vectors(spark, [(1, 1, None)]))[0] == []
    with pytest.raises(ValueError):
        coded(vectors(spark, [(1, 1, [1.0] * 5)]))
    with pytest.raises(Exception, match="64 bits"):
        coded(vectors(spark, [(1, 1, [1e30] * 16)]))
