"""License scans by diagonal voting.

Hashes of all runs of k words of a document are joined with the places of such runs in license texts. A
document place minus a template place is a diagonal; a passage copied from a template votes for one
diagonal, or for neighbouring ones where words were put in or left out. Votes are aggregated by document,
template and diagonal, close diagonals are merged into one span, and a span counts when enough of its
template's runs are in it and it is not much longer than what it covers; the words themselves were
compared by 64-bit hashes, run by run. Copies that stand close together merge into a span that is too
long; it is cut where the place in the template falls back, and each copy is judged by itself.

A run whose hash is in no template cannot join, so workers drop it before it leaves them (`may_join`,
one bit per hash value of 20 bits and hence of fixed size); the join decides. Templates are a few
thousand runs; the optimizer broadcasts their table only if it is small enough.

Nulls and edges: a null text is empty, has no words and no label; rows that repeat are scanned row by
row; a null id is carried along. A text is scanned whole, in one task, whatever its length; an empty table gives an
empty result. Only the two named columns are read, so further ones of any name change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import textscan
from .common import row_key, save

#: Phrases whose every occurrence counts, and their labels (fixed values of the query's contract).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices and texts of public licenses and their labels (fixed values: the licenses' own words).
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "this project is licensed under the terms of the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
        "permit persons to whom the software is furnished to do so subject to the following conditions",
    ),
    (
        "mit",
        "the above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the software",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
    ),
    ("apache", "licensed under the apache license version 2 0"),
    (
        "apache",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0",
    ),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation either version 3 of the license or at your "
        "option any later version",
    ),
    (
        "gpl",
        "this program is distributed in the hope that it will be useful but without any warranty without even the "
        "implied warranty of merchantability or fitness for a particular purpose",
    ),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under the creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under the creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license"),
    ("all-rights-reserved", "all rights reserved"),
]
GRAM = 4
#: Diagonals so close are one span; a span needs this share of its template's runs, and may be longer
#: than the template by this share.
DRIFT = 8
COVER_PERCENT = 60
STRETCH_PERCENT = 140
_BITS = 20

_TEMPLATE_SCHEMA = "template int, label string, phrase boolean, n_grams int, n_words int, gram bigint, at int"


def _hashes(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = textscan.word_bounds(data, np.array([0, len(data)]), textscan.gap_table())
    return textscan.word_hashes(textscan.lower_table()[data], starts, ends)


def _size_of(words: int, phrase: bool, gram: int) -> int:
    return min(2 if phrase else gram, words)


def template_grams(spark: SparkSession, templates: list[tuple[str, str]], phrases: dict[str, str], gram: int) -> DataFrame:
    """Every run of words of every template and its place. Phrases are cut into pairs of words, so that
    they are found at any length."""
    rows = []
    texts = [(label, text, False) for label, text in templates] + [(label, text, True) for text, label in phrases.items()]
    for number, (label, text, phrase) in enumerate(texts):
        words = _hashes(text.encode())
        k = _size_of(len(words), phrase, gram)
        grams = textscan.gram_hashes(words, k) ^ np.uint64(k)
        rows += [(number, label, phrase, len(grams), len(words), int(g), i) for i, g in enumerate(grams.view(np.int64))]
    return spark.createDataFrame(rows, _TEMPLATE_SCHEMA)


def _rolling(sizes: list[int], may_join: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower, gaps = textscan.lower_table(), textscan.gap_table()
        wanted = np.frombuffer(may_join, np.uint8).view(bool)
        for batch in batches:
            for first, last, data, offsets in textscan.text_runs(batch["text"]):
                starts, ends, at = textscan.word_bounds(data, offsets, gaps)
                words = textscan.word_hashes(lower[data], starts, ends)
                counts = np.diff(at)
                owner = np.repeat(np.arange(last - first), counts)
                rows, places, grams = [np.arange(last - first)], [np.full(last - first, -1)], [np.zeros(last - first, np.uint64)]
                for k in sizes:
                    made = textscan.gram_hashes(words, k) ^ np.uint64(k)
                    good = np.flatnonzero(wanted[made >> np.uint64(64 - _BITS)])
                    good = good[owner[good] == owner[good + k - 1]] if len(good) else good
                    rows.append(owner[good])
                    places.append(good - at[owner[good]])
                    grams.append(made[good])
                row = pa.array(np.concatenate(rows) + first)
                n = np.concatenate([counts, np.zeros(sum(map(len, rows[1:])), np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["key"].take(row),
                        batch["doc_id"].take(row),
                        pa.array(n.astype(np.int64)),
                        pa.array(np.concatenate(places).astype(np.int64)),
                        pa.array(np.concatenate(grams).view(np.int64)),
                    ],
                    names=["key", "doc_id", "n_words", "place", "gram"],
                )

    return run


def rolling_grams(docs: DataFrame, doc_id: str, text: str, sizes: list[int], may_join: bytes) -> DataFrame:
    """Per row one entry at place -1 with its number of words, and its runs of words that may join."""
    plain = docs.select(row_key(doc_id, text).alias("key"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    schema = f"key struct<a:bigint,b:bigint>, doc_id {kind}, n_words bigint, place bigint, gram bigint"
    return plain.mapInArrow(_rolling(sizes, may_join), schema)


_TEMPLATE = ("template", "label", "phrase", "n_grams", "t_words")


def _judged(votes: DataFrame) -> DataFrame:
    """Per span and copy: first and last word, score, covered (enough of the template) and too_long."""
    spans = votes.groupBy("key", *_TEMPLATE, "span", "copy").agg(
        F.count_distinct("at").alias("found"), F.min("place").alias("first"), F.max("place").alias("last_start")
    )
    k = F.col("t_words") - F.col("n_grams") + 1
    spans = spans.withColumn("last", F.col("last_start") + k - 1).withColumn("score", F.col("found") / F.col("n_grams"))
    covered = F.when(F.col("phrase"), F.col("found") == F.col("n_grams")).otherwise(
        F.col("found") * 100 >= F.col("n_grams") * COVER_PERCENT
    )
    stretched = (F.col("last") - F.col("first") + 1) * 100 > F.col("t_words") * STRETCH_PERCENT
    return spans.withColumn("covered", covered).withColumn("too_long", ~F.col("phrase") & stretched)


def find_licenses(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    templates: list[tuple[str, str]] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    gram: int = GRAM,
) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): key, doc_id, n_words, copies of every distinct document; and key, template,
    label, phrase, first, last (words) and score of every verified span."""
    spark = docs.sparkSession
    table = template_grams(spark, templates, phrases, gram)
    # The templates are this module's constants or the caller's list, already in the driver.
    texts = [(t, False) for _, t in templates] + [(t, True) for t in phrases]
    wanted, sizes = np.zeros(1 << _BITS, bool), set()
    for t, phrase in texts:
        words = _hashes(t.encode())
        k = _size_of(len(words), phrase, gram)
        sizes.add(k)
        wanted[(textscan.gram_hashes(words, k) ^ np.uint64(k)) >> np.uint64(64 - _BITS)] = True
    grams = save(rolling_grams(docs, doc_id, text, sorted(sizes), wanted.tobytes()), "grams")
    # Rows that repeat were scanned row by row; their votes must count once.
    heads = grams.filter("place < 0").groupBy("key").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.count(F.lit(1)).alias("copies")
    )
    per_diagonal = grams.filter("place >= 0").select("key", "place", "gram").join(
        table.withColumnRenamed("n_words", "t_words"), "gram"
    )
    per_diagonal = (
        per_diagonal.withColumn("diagonal", F.col("place") - F.col("at"))
        .groupBy("key", "template", "label", "phrase", "n_grams", "t_words", "diagonal")
        .agg(F.collect_set("at").alias("ats"))
    )
    near = Window.partitionBy("key", "template").orderBy("diagonal")
    drift = F.when(F.col("phrase"), 0).otherwise(DRIFT)
    fresh = F.col("diagonal") - F.lag("diagonal").over(near) > drift
    merged = per_diagonal.withColumn("fresh", F.coalesce(fresh, F.lit(True)).cast("int"))
    merged = merged.withColumn("span", F.sum("fresh").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    votes = F.transform("ats", lambda at: F.struct((F.col("diagonal") + at).alias("place"), at.alias("at")))
    merged = save(merged.withColumn("votes", votes).select("key", *_TEMPLATE, "span", "votes"), "votes")
    merged = merged.select("key", *_TEMPLATE, "span", F.explode("votes").alias("vote")).select("*", "vote.*").drop("vote")
    whole = _judged(merged.withColumn("copy", F.lit(0).cast("bigint")))
    # Within a copy the place in the template only goes up. A span that passes stays whole.
    in_order = Window.partitionBy("key", "template", "span").orderBy("place", "at")
    back = F.coalesce(F.col("at") <= F.lag("at").over(in_order), F.lit(False)).cast("int")
    long = whole.filter("too_long").select("key", "template", "span")
    copies = merged.join(long, ["key", "template", "span"], "left_semi").withColumn("back", back)
    copies = copies.withColumn("copy", F.sum("back").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = whole.unionByName(_judged(copies.drop("back"))).filter("covered and not too_long")
    return heads, spans.select("key", "template", "label", "phrase", "first", "last", "score")


def _joined(labels: Column) -> Column:
    return F.array_join(F.sort_array(F.array_distinct(labels)), ",")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row: doc_id, n_words, n_base (places of the phrases), first_word, last_word, base_labels,
    labels and score, the best share of a template that was found."""
    heads, spans = find_licenses(docs, doc_id, text, **options)
    is_base = F.col("phrase")
    per_doc = spans.groupBy("key").agg(
        F.count(F.when(is_base, True)).alias("n_base"),
        F.min(F.when(is_base, F.col("first"))).alias("first_word"),
        F.max(F.when(is_base, F.col("first"))).alias("last_word"),
        _joined(F.collect_list(F.when(is_base, F.col("label")))).alias("base_labels"),
        _joined(F.collect_list("label")).alias("labels"),
        F.max("score").alias("score"),
    )
    out = heads.join(per_doc, "key", "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("bigint")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
