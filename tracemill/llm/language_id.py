"""Language identification of whole texts, with spans for mixed ones.

Learning counts, over all documents with a label, how often each language uses each letter trigram (with
word borders; hashed into a fixed number of buckets) and each script. To predict, the script of a word
narrows its candidates to the languages that write in it; each candidate scores the word by its trigrams;
and a Viterbi pass over the words, with a penalty for switching, labels spans. A text's language is the
one that labels most of its letters, its score their share.

Nulls and edges: a text that is null or has no letter is `und` with score 0 and no spans; documents
without label or id teach nothing; ties go to the first language in order; without any labelled document
everything is `und`; rows that repeat count as often as they occur. Every word of a text is
scored, whatever its length; an empty table gives an empty result. Only the named columns are read, so further ones of
any name change nothing.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BUCKETS = 1 << 16
SMOOTHING = 0.5
SWITCH_PENALTY = 10.0
#: A language is a candidate in a script that makes up this share of its letters.
SCRIPT_SHARE = 0.01
UNDETERMINED = "und"
_RUN_CHARS = 1 << 20
_OUT_OF_SCRIPT = -60.0

#: First and last code point of the scripts told apart; other letters are one more (fixed values).
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F),
    ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F),
    ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("han", 0x20000, 0x323AF),
]
SCRIPT_NAMES = ["other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]

_tables: list = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """(lower-case letter or 0, script) of each code point."""
    if not _tables:
        low, script = np.zeros(0x110000, np.uint32), np.zeros(0x110000, np.uint8)
        for i in range(0x20000):
            c = chr(i)
            if unicodedata.category(c)[0] == "L":
                lowered = c.lower()
                low[i] = ord(lowered) if len(lowered) == 1 else i
        low[0x20000:0x323B0] = np.arange(0x20000, 0x323B0)
        for name, first, last in SCRIPTS:
            script[first : last + 1] = SCRIPT_NAMES.index(name)
        _tables.extend((low, script))
    return _tables[0], _tables[1]


@dataclass
class Words:
    """Words of a run of texts: places in the code points, text, letters' features, script."""

    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    offset: np.ndarray  # of the word in its text
    trigrams: np.ndarray  # one bucket per letter, words back to back
    script: np.ndarray


def split_words(texts: list[str]) -> Words:
    low, script = _letters()
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    heads = np.cumsum(sizes) - sizes
    letters = np.concatenate([[0], low[points], [0]]).astype(np.uint64)
    inside = letters != 0
    starts = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    ends = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    text = np.searchsorted(heads, starts, "right") - 1
    at = np.flatnonzero(inside[1:-1])
    mixed = letters[at] * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ letters[at + 1]) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ letters[at + 2]) * np.uint64(0x94D049BB133111EB)
    return Words(starts, ends, text, starts - heads[text], (mixed >> np.uint64(48)).astype(np.int64) % BUCKETS, script[points[starts]])


def _runs(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= _RUN_CHARS:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            trigrams, scripts = np.zeros(BUCKETS, np.int64), np.zeros(len(SCRIPT_NAMES), np.int64)
            for _, run in _runs(texts):
                words = split_words(run)
                trigrams += np.bincount(words.trigrams, minlength=BUCKETS)
                scripts += np.bincount(words.script, words.ends - words.starts, len(SCRIPT_NAMES)).astype(np.int64)
            for kind, counts in enumerate((trigrams, scripts)):
                used = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(used)), pa.array([kind] * len(used), pa.int32()), pa.array(used, pa.int32()), pa.array(counts[used])],
                    schema=pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())]),
                )


@dataclass
class Model:
    langs: list[str]
    log_p: np.ndarray  # buckets x languages
    candidates: np.ndarray  # scripts x languages


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Counts over all labelled rows; what comes to the driver is one number per language and bucket."""
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    rows = rows.filter("lang is not null and text is not null")
    counted = rows.mapInArrow(_counted, "lang string, kind int, bucket int, n bigint")
    table = counted.groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(table["lang"].unique())
    counts, scripts = np.zeros((BUCKETS, len(langs))), np.zeros((len(SCRIPT_NAMES), len(langs)))
    column = {name: i for i, name in enumerate(langs)}
    for kind, target in ((0, counts), (1, scripts)):
        part = table[table["kind"] == kind]
        target[part["bucket"].to_numpy(int), part["lang"].map(column).to_numpy(int)] = part["n"]
    log_p = np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * BUCKETS))
    candidates = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1)
    candidates[~candidates.any(1)] = True
    return Model(langs, log_p.astype(np.float32), candidates)


def word_scores(model: Model, words: Words) -> np.ndarray:
    """Words x languages: log-probability of the word's trigrams; far below for other scripts."""
    lengths = words.ends - words.starts
    heads = np.cumsum(lengths) - lengths
    scores = np.add.reduceat(model.log_p[words.trigrams], heads, axis=0)
    return np.where(model.candidates[words.script], scores, scores.min(1, keepdims=True) + _OUT_OF_SCRIPT)


def viterbi(scores: np.ndarray, heads: np.ndarray, counts: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Language of each word: the best path of each text, all texts in step, longest first."""
    back = np.empty(scores.shape, np.uint8)
    order = np.argsort(-counts, kind="stable")
    heads, counts = heads[order], counts[order]
    stay = np.arange(scores.shape[1], dtype=np.uint8)
    best = np.zeros((len(heads), scores.shape[1]), np.float32)
    active = np.searchsorted(-counts, -np.arange(int(counts.max(initial=0))), "left")
    # Sums are kept relative to the best path so far, so that long texts lose no precision.
    for t, n in enumerate(active.tolist()):
        now = best[:n]
        top = now.argmax(1)
        now -= now[np.arange(n), top][:, None]
        switch = now < -penalty
        back[heads[:n] + t] = np.where(switch, top[:, None].astype(np.uint8), stay)
        np.maximum(now, -penalty, out=now)
        now += scores[heads[:n] + t]
    path = np.empty(len(scores), np.uint8)
    state = best.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = heads[:n] + t
        path[at] = state[:n]
        state[:n] = back[at, state[:n]]
    return path


def label(model: Model, texts: list[str], penalty: float = SWITCH_PENALTY) -> tuple[list[str], list[float], list[list[tuple]]]:
    """(language, score, spans of (start, end, language) in code points) of each text."""
    names, shares = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    spans: list[list[tuple]] = [[] for _ in texts]
    owner, scores, starts, ends = [], [], [], []
    for first, run in _runs(texts):
        words = split_words(run)
        if len(words.starts) and model.langs:
            owner.append(words.text + first)
            scores.append(word_scores(model, words).astype(np.float32))
            starts.append(words.offset)
            ends.append(words.offset + words.ends - words.starts)
    if not owner:
        return names, shares, spans
    of, start, end = (np.concatenate(x).astype(np.int32) for x in (owner, starts, ends))
    counts = np.bincount(of, minlength=len(texts))
    path = viterbi(np.concatenate(scores), np.cumsum(counts) - counts, counts, penalty)
    letters = np.bincount(of.astype(np.int64) * len(model.langs) + path, end - start, len(texts) * len(model.langs))
    letters = letters.reshape(len(texts), -1)
    best = letters.argmax(1)
    for i in np.flatnonzero(counts):
        names[i] = model.langs[best[i]]
        shares[i] = float(letters[i, best[i]] / letters[i].sum())
    cut = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (path[1:] != path[:-1])])
    for a, b in zip(cut, np.r_[cut[1:], len(of)]):
        spans[of[a]].append((int(start[a]), int(end[b - 1]), model.langs[path[a]]))
    return names, shares, spans


def _predicted(model: Model, penalty: float):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, shares, spans = label(model, [t or "" for t in batch["text"].to_pylist()], penalty)
            spans = [[{"start": a, "end": b, "lang": c} for a, b, c in one] for one in spans]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(names, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, spans_type)],
                names=["doc_id", "held_out", "lang_pred", "score", "spans"],
            )

    return run


def held_out(doc_id) -> Column:
    """Every fourth document by a checksum of its id; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", penalty: float = SWITCH_PENALTY
) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score and spans, learned from the rows not held out."""
    plain = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), held_out(doc_id).alias("held_out")
    )
    model = learn(plain.filter(~F.col("held_out") & F.col("doc_id").isNotNull()))
    kind = plain.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, lang_pred string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>"
    return plain.drop("lang").mapInArrow(_predicted(model, penalty), schema)
