"""Registered queries on the smallest tables: against SQL where there is some, else brute force."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from tracemill.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def documents(tables):
    return tables.execute("select doc_id, text, lang, source from documents order by doc_id").fetchdf()


@pytest.fixture(scope="module")
def token_ids(documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made = tool.encode_batch(list(documents.text), add_special_tokens=False)
    return {i: np.array(e.ids, "<u4") for i, e in zip(documents.doc_id, made)}


def result(spark, name):
    return QUERIES[name](spark, SF).toPandas()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, tables, name):
    got, expected = result(spark, name), tables.execute(ORACLE_SQL[name]).fetchdf()
    order = sorted(got.columns)
    assert order == sorted(expected.columns)
    key = "doc_id" if "doc_id" in order else "vec_id"
    got, expected = (x[order].sort_values(key).reset_index(drop=True) for x in (got, expected))
    pd.testing.assert_frame_equal(got, expected, check_dtype=False)


def test_language_id(spark, documents):
    got = result(spark, "op1_language_id").set_index("doc_id").sort_index()
    assert list(got.held_out) == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.index]
    truth = documents.set_index("doc_id").lang
    held = got[got.held_out]
    assert (held.lang_pred == truth[held.index]).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_packing(spark, token_ids):
    assert dict(QUERIES["op3_best_fit_packing"](spark, SF).dtypes)["piece"] == "int"
    got = result(spark, "op3_best_fit_packing")
    for r in got.itertuples():
        ids = np.append(token_ids[r.doc_id], 2).astype("<u4")
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for doc_id, pieces in got.sort_values("piece").groupby("doc_id"):
        assert list(pieces.piece) == list(range(len(pieces)))
        assert list(pieces.start) == [0, *np.cumsum(pieces.length)[:-1]]
        assert pieces.length.sum() == len(token_ids[doc_id]) + 1
        assert (pieces.length.iloc[1:] == 1024).all()
    for _, held in got.sort_values("offset").groupby("sequence_id"):
        assert list(held.offset) == [0, *np.cumsum(held.length)[:-1]] and held.length.sum() <= 1024
    bound = -(-got.length.sum() // 1024)
    assert got.sequence_id.nunique() <= bound + max(2, bound // 50)


def test_license_scan(spark, documents):
    got = result(spark, "op4_license_scan").set_index("doc_id")
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for i, text in zip(documents.doc_id, documents.text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(UPPER))
        places, labels = [], set()
        for phrase, label in phrases.items():
            parts = phrase.split()
            found = [k for k in range(len(words)) if words[k : k + len(parts)] == parts]
            places += found
            labels |= {label} if found else set()
        row = got.loc[i]
        assert (row.n_words, row.n_base, row.base_labels) == (len(words), len(places), ",".join(sorted(labels)))
        assert labels <= set(row.labels.split(","))
        if places:
            assert (row.first_word, row.last_word) == (min(places), max(places))
        else:
            assert pd.isna(row.first_word) and pd.isna(row.last_word)


def repeats(rows):
    """Brute force over (id, bytes): the contract's definition, string by string."""
    owner, out = {}, {}
    for i, data in sorted(rows):
        for k in range(len(data) - 49):
            owner.setdefault(data[k : k + 50], i)
    for i, data in rows:
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - 49):
            if owner[data[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[i] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot, crowded", [(4096, 4096), (1, 4096), (4096, 0), (4096, 3)])
def test_suffix_dedup(spark, documents, hot, crowded):
    from tracemill.llm import suffix_dedup

    expected = repeats([(i, t.encode()) for i, t in zip(documents.doc_id, documents.text)])
    got = suffix_dedup.remove_repeats(
        spark.read.parquet(f"{SF}/documents.parquet"), hot_blocks=hot, hot_pieces=crowded
    ).toPandas()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.itertuples()} == expected
    assert got.n_removed.sum() > 0


def test_token_counts(spark, token_ids):
    got = result(spark, "op6_token_counts").set_index("doc_id")
    assert dict(got.n_tokens) == {i: len(x) for i, x in token_ids.items()}
    assert got.closed.all()


def test_html_extraction(spark, tables):
    import html

    got = result(spark, "op8_html_extraction").set_index("page_id")
    for page_id, source in tables.execute("select page_id, html from pages").fetchall():
        article = re.search(r"<article>(.*?)</article>", source, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got.text[page_id] == "\n".join(b for b in blocks if b)
        assert got.n_chars[page_id] == len(got.text[page_id])


ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"


def base_spans(text):
    spans = []
    for kind, pattern, group, least in ((0, ASSIGN, 2, 6), (1, r"AKIA[A-Z0-9]+", 0, 20), (2, r"[0-9a-f]+", 0, 24)):
        spans += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return sorted(spans)


def test_secret_scan(spark, tables):
    folder = "/root/testdata/sf0.01"  # the smallest table that has secrets
    got = QUERIES["op10_secret_scan"](spark, folder).toPandas().set_index("doc_id")
    names = ["assign", "access", "hex"]
    for i, text in tables.execute(f"select doc_id, text from '{folder}/documents.parquet'").fetchall():
        spans = base_spans(text)
        said = [f"{names[k]}:{a}:{b}" for a, k, b in spans]
        assert got.base_sha256[i] == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert (got.n_assign[i], got.n_access[i], got.n_hex[i]) == tuple(sum(k == n for _, k, _ in spans) for n in range(3))
        assert set(said) <= set(got.spans[i].split(","))
    assert got.n_assign.sum() > 0
