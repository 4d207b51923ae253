"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns,
and on small cases of its own."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tracemill.llm import (
    bwt, decontamination, html_text, language_id, licenses, minhash, packing, quality, secrets, suffix_dedup,
    textscan, token_counts, tokens,
)

BENCH = "item_id bigint, text string, key string"


@pytest.fixture(scope="module")
def odd(make_docs, odd_rows):
    return make_docs(odd_rows)


@pytest.fixture(scope="module")
def empty(make_docs):
    return make_docs([])


def rows(df):
    return df.collect()


# Quality ---------------------------------------------------------------------------------------


def test_quality_of_odd_rows(odd, empty):
    got = rows(quality.judge(odd))
    assert len(got) == 11
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].kept and by[1].n_words == 23 and by[6].n_words == 40_000 and by[6].kept
    assert all(by[i].base_failed and not by[i].kept and by[i].n_words == n for i, n in ((3, 0), (4, 0), (5, 0), (7, 2)))
    assert by[7].n_symbols == 3
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in rows(kept)) == [0, 1, 1, 2, 6]
    assert rows(quality.judge(empty)) == [] and rows(quality.keep_good(empty)) == []


def test_repeated_windows_and_lines(make_docs):
    a = "a b c d e f g h"
    got = {r.doc_id: r for r in rows(quality.judge(make_docs([(1, f"{a} x {a}", "en", "s"), (2, " ".join(["a"] * 30), "en", "s"), (3, "l\n l\nl\n\n \nl", "en", "s")])))}
    assert got[1].n_repeat_words == 16 and got[2].n_repeat_words == 30 and got[3].n_dup_lines == 2


def test_depleted_documents(make_docs):
    limits = quality.Limits(line_documents=5, line_percent=5)
    menus = ["home products about us contact imprint", "privacy terms cookies jobs press help", "follow share like print mail rss feed now"]
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    full = [(i, "\n".join([*menus, body(i)]), "en", "s") for i in range(20)]
    copies = [(100 + i, f"{body('c')}\n{body('d')}", "en", "s") for i in range(20)]
    only = [(50 + i, "\n".join([menus[0].upper(), menus[1] + " ", menus[2], f"x{i}"]), "en", "s") for i in range(3)]
    got = {r.doc_id: r for r in rows(quality.judge(make_docs(full + copies + only), limits=limits))}
    assert all(got[i].kept for i, *_ in full + copies)
    assert all(got[i].depleted and not got[i].base_failed for i, *_ in only)
    elsewhere = {r.doc_id: r for r in rows(quality.judge(make_docs(full + [(50, only[0][1], "en", "other")]), limits=limits))}
    assert not elsewhere[50].depleted


@pytest.mark.parametrize("words", [1 << 17, 1])
def test_what_is_left_must_be_enough(make_docs, words, monkeypatch):
    monkeypatch.setattr(quality, "_MAP_WORDS", words)  # with one word, every document may hold frequent lines
    lines = [" ".join(f"l{k}x{j}" for j in range(100)) for k in range(10)]
    long = lambda i, n: "\n".join([*lines, " ".join(f"own{i}x{k}" for k in range(n))])
    docs = [(i, long(i, 6 if i < 150 else 20), "en", "s") for i in range(160)]
    docs += [(200, " ".join(f"a{k}" for k in range(30)), "en", "s")]
    kept = quality.keep_good(make_docs(docs))
    assert sorted((r.doc_id, len(r.text.split())) for r in rows(kept)) == [*((i, 20) for i in range(150, 160)), (200, 30)]


def test_frequent_lines_leave_the_text(make_docs):
    limits = quality.Limits(line_documents=5, line_percent=5)
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    docs = [(i, f"Home  Products\n\n{body(i)}\n home products \r\nend{i}", "en", None if i % 2 else "s") for i in range(20)]
    docs += [(50, f"home products\n{body(50)}", "en", "other"), (51, "home products\nx", "en", "s")]
    kept = quality.keep_good(make_docs(docs), limits=limits)
    assert kept.columns == make_docs(docs).columns
    got = {r.doc_id: r.text for r in rows(kept)}
    assert got == {i: f"\n{body(i)}\nend{i}" for i in range(20)} | {50: docs[20][1]}


# Near duplicates -----------------------------------------------------------------------------------


def brute_components(docs, size=4, percent=80):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and both * 100 >= percent * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("small", [64, 2])
def test_near_duplicates_against_brute_force(make_docs, small, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    draw = random.Random(3)
    base = [f"w{draw.randrange(999)}" for _ in range(60)]
    docs = []
    for i in range(60):
        words = list(base) if i % 3 else [f"v{draw.randrange(999)}" for _ in range(50)]
        for _ in range(draw.randrange(5)):
            words[draw.randrange(len(words))] = f"z{draw.randrange(9)}"
        docs.append((i, " ".join(words)))
    docs += [(100, "one two"), (101, "One  two"), (102, "one two three"), (103, ""), (104, " ")]
    label, sizes = brute_components(docs)
    got = {r.doc_id: r for r in rows(minhash.near_duplicates(make_docs([(i, t, "en", "s") for i, t in docs])))}
    assert {i: r.component_id for i, r in got.items()} == label
    assert {i: r.n_shingles for i, r in got.items()} == sizes


def test_near_duplicates_of_odd_rows(odd, empty):
    got = rows(minhash.near_duplicates(odd))
    assert len(got) == 11
    assert sorted(r.component_id or 0 for r in got if r.n_shingles > 10 and r.n_shingles < 100) == [1, 1, 1, 1]
    kept = minhash.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0, r.text is None) for r in rows(kept)) == [(0, True), (1, False), (3, True), (4, False), (5, False), (6, False), (7, False), (8, False)]
    assert rows(minhash.near_duplicates(empty)) == [] and rows(minhash.keep_first(empty)) == []


def test_components_of_a_path(spark):
    pairs = [(bytes([i]), bytes([i + 1])) for i in range(20)] + [(b"x", b"y")]
    got = {bytes(r.node): bytes(r.root) for r in rows(minhash.components(spark.createDataFrame(pairs, "u binary, v binary"), "t"))}
    assert got == {bytes([i]): b"\0" for i in range(1, 21)} | {b"y": b"x"}


# Decontamination --------------------------------------------------------------------------------------


def test_decontamination_of_odd_rows(spark, odd, empty):
    item = "Brown fox jumps over the lazy dog, and then goes!"
    bench = spark.createDataFrame([(1, item, "k"), (2, None, "k"), (3, "", "k"), (None, item, "k"), (4, "old oak", "k"), (4, "old oak", "k")], BENCH)
    got = rows(decontamination.contamination(odd, bench))
    assert len(got) == 11
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert (by[1].n_words, by[1].n_hit, by[1].item_ids) == (23, 12, ["1", "4"])
    assert by[6].n_words == 40_000 and not by[6].contaminated and by[3].n_words == 0
    left = decontamination.remove_contaminated(odd, bench)
    assert left.columns == odd.columns and sorted(r.doc_id or 0 for r in rows(left)) == [0, 3, 4, 5, 6, 7, 8]
    none = spark.createDataFrame([], BENCH)
    assert rows(decontamination.contamination(empty, bench)) == []
    assert not any(r.contaminated for r in rows(decontamination.contamination(odd, none)))


def test_windows_of_every_length(spark, make_docs):
    draw = random.Random(5)
    word = lambda: draw.choice("abcdefgh")
    docs = [(i, " ".join(word() for _ in range(draw.randrange(1, 60))), "en", "s") for i in range(40)]
    items = [(i, " ".join(word() for _ in range(draw.choice([2, 3, 4, 5, 7, 9, 10, 11, 14])))) for i in range(25)]
    items += [(90 + i, " ".join(t.split()[3:16])) for i, t, *_ in docs[:8]]
    got = {r.doc_id: r for r in rows(decontamination.contamination(make_docs(docs), spark.createDataFrame([(i, t, "k") for i, t in items], BENCH)))}
    for i, text, *_ in docs:
        words, hit, named = text.split(), set(), set()
        for j, item in items:
            own = item.split()
            n = min(10, len(own))
            windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if own else set()
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    named.add(str(j))
        assert (got[i].n_hit, got[i].item_ids) == (len(hit), sorted(named))


# Secrets -------------------------------------------------------------------------------------------------


def test_secrets_of_odd_rows(odd, empty):
    assert all(r.n_assign == r.n_hex == 0 for r in rows(secrets.scan(odd))) and secrets.scan(odd).count() == 11
    masked = secrets.redact(odd)
    assert masked.columns == odd.columns and sorted(map(str, rows(masked))) == sorted(map(str, rows(odd)))
    assert rows(secrets.scan(empty)) == [] and rows(secrets.redact(empty)) == []


def test_examples_and_live_values(make_docs):
    live, copied = "0123456789abcdef01234567", "fedcba9876543210fedcba98"
    docs = [(i, f"é {copied} and", "en", f"s{i}") for i in range(6)] + [(10, f'Token: "{live}" password=abc {live}', "en", "s0")]
    docs += [(20 + i, "key ghp_" + "Zq" * 18 + " x", "en", f"s{i}") for i in range(6)] + [(30, "ghp_" + "Yq" * 18, "en", "s1")]
    got = {r.doc_id: r for r in rows(secrets.scan(make_docs(docs)))}
    assert [(s.start, s.kind, s.end) for s in got[0].base] == [(2, 2, 26)] and got[0].n_example == 1 and got[0].n_live == 0
    assert [(s.start, s.kind, s.end) for s in got[10].spans] == [(0, 0, 32), (8, 2, 32), (47, 2, 71)] and got[10].n_live == 3
    assert got[20].n_provider == 1 and got[20].spans == [] and [s.kind for s in got[30].spans] == [3]
    text = {r.doc_id: r.text for r in rows(secrets.redact(make_docs(docs)))}
    assert text[10] == '<SECRET>" password=abc <SECRET>' and text[0] == docs[0][1] and text[30] == "<SECRET>"


def test_many_spans(make_docs):
    text = " ".join(f"token={i:08d}" for i in range(1000))
    (row,) = rows(secrets.scan(make_docs([(1, text, "en", "s")])))
    assert [(s.start, s.end) for s in row.base] == [(15 * i, 15 * i + 14) for i in range(1000)]


# Packing -------------------------------------------------------------------------------------------------


def test_packing_of_odd_rows(odd, empty):
    got = packing.pack(odd).toPandas()
    assert got.drop_duplicates(["sequence_id", "offset"]).shape == got.shape
    assert len(got[got.doc_id == 1]) == 2 and got[got.doc_id == 3].length.tolist() == [1]
    assert (got[got.doc_id == 6].sort_values("piece").length.iloc[1:] == 1024).all()
    assert packing.pack(empty).count() == 0


def _packed(spark, counts, most):
    """Places (offset, length) by sequence of the runs for `counts`, each rank used once."""
    held, used = {}, {}
    counted = spark.createDataFrame(list(counts.items()), "size bigint, n bigint")
    for r in packing.best_fit(counted, most).collect():
        for k in range(r.n):
            for t in range(r.take):
                held.setdefault(r.sequence + k, []).append((r.offset + t * r.size, r.size))
                used.setdefault(r.size, []).append(r.first + k * r.take + t)
    assert {n: sorted(x) for n, x in used.items()} == {n: list(range(c)) for n, c in counts.items()}
    for places in held.values():
        places.sort()
        assert [o for o, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1]] and sum(n for _, n in places) <= most
    assert sorted(held) == list(range(len(held)))
    return held


@pytest.mark.parametrize("seed", range(2))
def test_supersteps_against_best_fit_decreasing(spark, seed):
    draw = random.Random(seed)
    counts = {draw.randrange(1, 101): draw.randrange(1, 60) for _ in range(40)} | {100: 3}
    held = _packed(spark, counts, 100)
    gaps = []  # plain best-fit decreasing, document by document
    for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fits = [g for g in gaps if g >= length]
        size = min(fits) if fits else 100
        if fits:
            gaps.remove(size)
        gaps.append(size - length)
    assert len(held) <= 1.02 * len(gaps) + 1


def test_equal_documents_go_in_bundles(spark, monkeypatch):
    steps, plain = [], packing.superstep
    monkeypatch.setattr(packing, "superstep", lambda *x: steps.append(0) or plain(*x))
    assert len(_packed(spark, {1: 1000}, 100)) == 10 and len(steps) == 1
    assert len(_packed(spark, {51: 30, 49: 30}, 100)) == 30
    assert len(_packed(spark, {100: 2, 34: 7}, 100)) == 2 + 4


def test_a_superstep_gives_each_document_its_successor(spark):
    state = [("gap", 50, 0, 2), ("gap", 30, 2, 1), ("gap", 70, 3, 1), ("doc", 30, 0, 2), ("doc", 40, 5, 1), ("doc", 80, 0, 1)]
    df = spark.createDataFrame([(*x, None, None, None) for x in state], ", ".join(f"{c} {t}" for c, t in packing.STATE))
    got = sorted(tuple(r) for r in packing.superstep(df, 100).collect())
    assert [x[:4] for x in got if x[0] == "doc"] == [("doc", 80, 0, 1)]
    runs = [(size, n, offset) for kind, size, _, n, _, _, offset in got if kind == "run"]
    assert sorted(runs) == [(30, 1, 50), (30, 1, 70), (40, 1, 50)]
    # The gap of 30 is filled and the one of 70 is left; those of 50 shrink, but 10 and 20 hold no document any more.
    assert sorted((size, n) for kind, size, _, n, *_ in got if kind == "gap") == [(10, 1), (20, 1), (70, 1)]


def test_ranks_in_shares(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 7)
    df = spark.range(100).selectExpr("id", "id % 2 as length", "id as salt")
    got = packing.with_rank(df, "length", "salt", "rank").toPandas()
    assert all(sorted(x) == list(range(50)) for _, x in got.groupby("length")["rank"])


# Tokens ------------------------------------------------------------------------------------------------------


def test_ids_equal_the_tokenizer_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    draw, letters = random.Random(1), "ab Z'é ñ0½ \n\t   !#😀中<|endoftext|>Ⅷ \r's\u0085\x1c"
    texts = ["", None, "it's I'll", "<|endoftext|>", *("".join(draw.choice(letters) for _ in range(draw.randrange(30))) for _ in range(500))]
    texts += [f"a{x}<|endoftext|>{y}b" for x in ("", " ", "\n", "  \t") for y in ("", " ", "\n ", "<|endoftext|>")]
    for added in (True, False):
        tool.encode_special_tokens = not added
        got = [x.tolist() for x in tokens.encode_column(pa.array(texts), tokens.vocabulary_path(), added)]
        assert got == [e.ids for e in tool.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_packed_ids_are_the_librarys(make_docs):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    text = "a <|endoftext|> b"
    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert ids == [64, 220, 50256, 275]
    (got,) = packing.pack(make_docs([(1, text, "en", "s")])).collect()
    assert (got.length, got.ids_crc32) == (5, zlib.crc32(np.array([*ids, 2], "<u4").tobytes()))


def test_ids_too_wide_for_the_file_end_the_job(make_docs):
    blocks = token_counts.flat_blocks(make_docs([(1, "some text", "en", "s")]), "doc_id", "text", tokens.vocabulary_path(), dtype="u1")
    with pytest.raises(Exception, match="does not fit"):
        blocks.collect()


def test_token_counts_of_odd_rows(odd, empty):
    got = token_counts.named_counts(odd).toPandas()
    assert len(got) == 11 and got[got.doc_id == 3].n_tokens.tolist() == [0] and got[got.doc_id == 6].n_tokens.iloc[0] > 40_000
    assert token_counts.named_counts(empty).count() == 0


@pytest.mark.parametrize("stride", [1024, 2])
def test_separator_scan(spark, monkeypatch, stride):
    monkeypatch.setattr(token_counts, "STRIDE", stride)
    draw = random.Random(2)
    files, blocks = {}, []
    for file in range(4):
        ids = [9 if draw.random() < 0.1 else 1 for _ in range(200)] if file else [1] * 50
        files[file] = ids
        blocks += [(file, k, bytearray(np.array(ids[k * 16 : k * 16 + 16], "<u2").tobytes())) for k in range(-(-len(ids) // 16))]
    blocks.append((7, 0, None))
    df = spark.createDataFrame(blocks, "file bigint, block bigint, data binary")
    got = token_counts.count_tokens(token_counts.scan_blocks(df, 9)).toPandas()
    for file, ids in files.items():
        expected, run = [], 0
        for x in ids:
            run += x != 9
            if x == 9:
                expected.append((run, True))
                run = 0
        expected += [(run, False)] if run else []
        mine = got[got.file == file].sort_values("ordinal")
        assert list(zip(mine.n_tokens, mine.closed)) == expected and mine.ordinal.tolist() == list(range(len(expected)))
    assert not len(got[got.file == 7])


# Licenses -------------------------------------------------------------------------------------------------------


def test_licenses_of_odd_rows(odd, empty):
    got = licenses.scan(odd).toPandas()
    assert len(got) == 11 and (got.labels == "").all() and got[got.doc_id == 6].n_words.tolist() == [40_000]
    assert licenses.scan(empty).count() == 0


def test_changed_license_text(make_docs):
    words = licenses.TEMPLATES[2][1].split()
    changed = " ".join(words[:20] + ["really"] + words[20:40] + words[42:])
    docs = [(1, f"x y {changed} z", "en", "s"), (2, " ".join(words[:12]), "en", "s"), (3, "Apache License of the MIT-license", "en", "s")]
    got = {r.doc_id: r for r in rows(licenses.scan(make_docs(docs)))}
    assert got[1].labels == "mit" and 0.6 < got[1].score < 1 and got[1].n_base == 0
    assert got[2].labels == ""
    assert (got[3].base_labels, got[3].first_word, got[3].last_word, got[3].n_base) == ("apache,mit", 0, 4, 2)


def test_repeated_short_notices(make_docs):
    nc = "Licensed under CC BY-NC 4.0."
    docs = [
        (1, "copyright 2020 foo all rights reserved copyright 2021 bar all rights reserved"), (2, f"{nc} {nc}"),
        (3, "all rights reserved " * 5), (4, f"Licensed under CC BY-NC 4 {nc} x {nc}"), (5, nc), (6, "licensed under cc by and by nc 4 0"),
    ]
    df = make_docs([(i, t, "en", "s") for i, t in docs])
    got = {r.doc_id: (r.labels, r.score) for r in rows(licenses.scan(df))}
    assert [got[i] for i in (1, 3)] == [("all-rights-reserved", 1.0)] * 2 and [got[i] for i in (2, 4, 5)] == [("cc-by-nc", 1.0)] * 3
    assert got[6] == ("", 0.0)
    _, spans = licenses.find_licenses(df)
    assert sorted((r.first, r.last) for r in rows(spans) if r.label == "all-rights-reserved") == [(0, 2), (3, 5), (3, 5), (6, 8), (9, 11), (9, 11), (12, 14)]


# Suffix dedup ----------------------------------------------------------------------------------------------------


def test_merged_transforms():
    draw = random.Random(1)
    strings = [bytes(draw.choice(b"ab\0") for _ in range(draw.randrange(1, 40))) for _ in range(60)]
    shards = bwt.Shards([strings[k : k + 7] for k in range(0, 60, 7)], 5)
    place, interval = bwt.merge(shards)
    text = [shards.symbols[p : p + 5] for p in place]
    full = [(tuple(t), g) for t, g in zip(text, interval) if len(t) == 5 and 0 not in t]
    assert [t for t, _ in full] == sorted(t for t, _ in full)
    assert len({t for t, _ in full}) == len({g for _, g in full}) == len(set(full))


def test_window_owners(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 900)
    draw = random.Random(4)
    base = bytes(draw.choice(b"abc") for _ in range(300))
    strings = [base[a : a + draw.randrange(50, 99)] for a in (draw.randrange(200) for _ in range(80))]
    owners = np.array([draw.randrange(1000) for _ in strings])
    low = {}
    for s, o in zip(strings, owners):
        for k in range(len(s) - 49):
            low[s[k : k + 50]] = min(low.get(s[k : k + 50], 10**9), o)
    got = suffix_dedup.window_owners(strings, owners)
    assert all(list(g) == [low[s[k : k + 50]] for k in range(len(s) - 49)] for s, g in zip(strings, got))


def test_suffix_dedup_of_odd_rows(odd, empty):
    got = rows(suffix_dedup.remove_repeats(odd))
    assert len(got) == 11
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].n_removed == 0 and by[2].n_removed == by[2].n_bytes and by[3].n_bytes == 0 and by[6].n_removed == 0
    (last,) = [r for r in got if r.doc_id is None and r.n_bytes]
    assert last.n_removed == by[1].n_bytes and bytes(last.kept) == b" today"
    assert by[3].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows(suffix_dedup.remove_repeats(empty)) == []


def test_anchors_do_not_depend_on_chunks(monkeypatch):
    draw = random.Random(6)
    data = bytes(draw.choice(b"ab") for _ in range(3000)) + b"x" * 300
    whole = suffix_dedup.Pieces(data, [1000, 3300])
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 37)
    parts = suffix_dedup.Pieces(data, [1000, 3300])
    for name in ("doc", "at", "first", "last", "anchor", "content", "left", "right"):
        assert (getattr(whole, name) == getattr(parts, name)).all()
    inside = (whole.at >= whole.last) & (whole.at <= whole.first + suffix_dedup.WIDTH - 1)
    assert inside.all() and len(whole.at) > 100


def test_line_that_most_documents_hold(spark, make_docs):
    line = "subscribe to our newsletter and never miss a single update"
    texts = [f"own words {i} of document {i * i}\n{line}\nmore words {i * 7}, and the end" for i in range(400)]
    docs = make_docs([(i, t, "en", "s") for i, t in enumerate(texts)])
    plain = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in rows(suffix_dedup.remove_repeats(docs))}
    crowded = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in rows(suffix_dedup.remove_repeats(docs, hot_pieces=20))}
    seen = set()
    for i, t in enumerate(texts):
        raw = t.encode()
        windows = [raw[k : k + 50] for k in range(len(raw) - 49)]
        gone = bytearray(len(raw))
        for k, w in enumerate(windows):
            if w in seen:
                gone[k : k + 50] = b"\1" * 50
        seen.update(windows)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        assert plain[i][0] == crowded[i][0] == sum(gone) and plain[i][2] == crowded[i][2] == hashlib.sha256(kept).hexdigest()
    assert sum(n > 0 for n, _, _ in plain.values()) == 399
    assert not [t for t in spark.catalog.listTables() if "blocks" in t.name]


def test_one_repeated_byte(make_docs):
    got = {r.doc_id: r for r in rows(suffix_dedup.remove_repeats(make_docs([(1, "a" * 70, "en", "s"), (2, "b" + "a" * 300 + "c", "en", "s"), (3, "a" * 49, "en", "s")])))}
    assert (got[1].n_removed, got[2].n_removed, got[2].n_spans, got[3].n_removed) == (0, 300, 1, 0)


# Language ----------------------------------------------------------------------------------------------------------


def test_language_of_odd_rows(odd, empty):
    got = rows(language_id.identify(odd))
    assert len(got) == 11
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].spans == [] for i in (3, 4, 5, 7))
    assert by[1].lang_pred == by[6].lang_pred == "en" and by[6].spans[0].end == len("x" * by[6].spans[0].end)
    assert rows(language_id.identify(empty)) == []


def test_mixed_text_and_scripts(make_docs):
    english = "the cat and the dog went over the hill with the other dogs then they came home "
    german = "der hund und die katze gingen durch den wald und kamen nicht mehr nach hause zurück "
    russian = "собака и кошка пошли через лес и пришли домой поздно вечером "
    docs = [(i, t * 3, g, "s") for i, (t, g) in enumerate([(english, "en"), (german, "de"), (russian, "ru")] * 4)]
    model = language_id.learn(make_docs(docs))
    names, scores, spans = language_id.label(model, [english * 2 + german + russian, "лес", "", "12 34"])
    assert [s[2] for s in spans[0]] == ["en", "de", "ru"] and names == ["en", "ru", "und", "und"]
    assert abs(spans[0][0][1] - 2 * len(english)) < 12 and 0.3 < scores[0] < 0.7


def test_viterbi_against_every_path():
    draw = np.random.default_rng(0)
    scores = draw.normal(size=(7, 3)).astype(np.float32) * 2
    got = language_id.viterbi(scores, np.array([0, 2]), np.array([2, 5]), 1.5)
    for a, n in ((0, 2), (2, 5)):
        value = lambda p, a=a: sum(scores[a + i, x] for i, x in enumerate(p)) - 1.5 * sum(x != y for x, y in zip(p, p[1:]))
        best = max(value(p) for p in np.ndindex(*[3] * n))
        assert abs(value(tuple(got[a : a + n])) - best) < 1e-4


# HTML --------------------------------------------------------------------------------------------------------------


def test_html_of_odd_pages(spark):
    article = "<article class='post'><h2>T &amp; t</h2><p>One <b>two\n three<br>four<p>Five</article>"
    other = "<div class='comments'><p>nice</p></div><!-- <p>x</p> --><script>var a='<p>';</script>"
    pages = [
        (1, "u", f"<html><body><nav><ul><li>Menu<li>More</ul></nav>{article}{other}<footer>f</footer>"),
        (1, "u", f"<html><body><nav><ul><li>Menu<li>More</ul></nav>{article}{other}<footer>f</footer>"),
        (2, None, None), (3, "u", ""), (None, "u", "<article><div class=ad><p>buy</p></div><p>" + "long " * 50_000), (4, "u", "<nav>a <"),
    ]
    df = spark.createDataFrame([(*p, "k") for p in pages], "page_id bigint, url string, html string, text string")
    got = rows(html_text.extract(df))
    assert [r.text for r in got if r.page_id == 1] == ["T & t\nOne two three four\nFive"] * 2
    assert [(r.text, r.n_chars) for r in got if r.page_id in (2, 3, 4)] == [("", 0)] * 3
    assert [r.n_chars for r in got if r.page_id is None] == [249_999]
    assert rows(html_text.extract(df.limit(0))) == []


def test_pages_whose_names_say_nothing_or_mislead(spark, tables):
    pages = tables.execute("select page_id, html from pages").fetchall()

    def silent(h):
        return re.sub(r"<(/?)(nav|article|footer)\b[^>]*>", r"<\1div>", re.sub(r'<div class="[^"]*">', "<div>", h))

    kinds = [
        lambda h: h, silent, lambda h: h.replace("<body>", '<body class="with-sidebar">'),
        lambda h: h.replace("<body>", '<body><div class="layout has-sidebar">'),
        lambda h: silent(h).replace("<body>", '<body class="with-sidebar">'),
    ]
    made = [(i * 10 + k, "u", change(h)) for i, h in pages for k, change in enumerate(kinds)]
    got = {r.page_id: r.text for r in rows(html_text.extract(spark.createDataFrame(made, "page_id bigint, url string, html string")))}
    right = [sum(got[i * 10 + k] == got[i * 10] != "" for i, _ in pages) for k in range(5)]
    assert right[2:4] == [len(pages)] * 2 and min(right[1], right[4]) >= 0.9 * len(pages)


def test_decoding_keeps_no_child_of_a_dropped_node():
    nodes = html_text.read_pages(["<div><p>a</p><section><p>b</p></section></div><div><p>c</p></div>"])
    draw = np.random.default_rng(1)
    for _ in range(50):
        kept = html_text.decode(nodes, draw.uniform(size=len(nodes.page)))
        assert all(kept[p] for k, p in zip(kept, nodes.parent) if k and p >= 0)


def test_runs_and_words():
    texts = pa.array(["ab  cd", None, "", "e", " f\tg"])
    for first, last, data, offsets in textscan.text_runs(texts):
        starts, ends, at = textscan.word_bounds(data, offsets, textscan.space_table())
        assert [bytes(data[a:b]) for a, b in zip(starts, ends)] == [b"ab", b"cd", b"e", b"f", b"g"] and at.tolist() == [0, 2, 2, 2, 3, 5]
        assert (first, last) == (0, 5)
