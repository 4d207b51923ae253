"""Benchmark decontamination by winnowing.

Of every run of w consecutive k-word grams the one with the smallest hash is a fingerprint, on both
sides alike, so texts that share w + k - 1 words in a row share a fingerprint inside them. The
fingerprints of the corpus are joined with those of the benchmark; each meeting is extended word by
word to both sides, which also confirms it, and counts if the common run is long enough.

Items shorter than the window are windows of their own length: the same is then done once for each
such length (at most window - 1 of them). Documents are shuffled at most once, and only to bring
words to the few that have a fingerprint in common.

Nulls and edges: a null text has no words; a null item id counts as a hit but has no name to list;
rows that repeat give repeated results. A text is compared whole, as one row, whatever its length. An empty table of
documents gives an empty result, an empty benchmark hits nothing. Only the named columns are read; rows that are kept
keep all their columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ALNUM_GAP, lower_ascii, row_key, save, split_words, whole_row, with_grams, with_window_min

WINDOW = 10
GRAM = 4


def words_of(text) -> Column:
    return split_words(lower_ascii(text), ALNUM_GAP)


def _with_fingerprints(df: DataFrame, words: str, length: int, gram: int) -> DataFrame:
    """Append all grams and the distinct fingerprints among them for windows of `length` words."""
    k = min(gram, length)
    df = df.withColumn("hashes", F.transform(words, lambda x: F.xxhash64(x)))
    df = with_grams(df, "hashes", "grams", k).drop("hashes")
    df = with_window_min(df, "grams", "minima", length - k + 1)
    return df.withColumn("prints", F.array_distinct("minima")).drop("minima")


def _around(words: str, place: Column, length: int, k: int) -> Column:
    """The words that a window holding the gram at `place` can hold; null beyond the text."""
    reach = length - k
    return F.transform(
        F.sequence(F.lit(-reach), F.lit(k + reach - 1)), lambda o: F.get(F.col(words), place + o)
    )


def _places(df: DataFrame, words: str, chosen: str, length: int, k: int) -> Column:
    """Places, grams and surroundings of the grams that are among the chosen ones."""
    found = F.transform(
        "grams",
        lambda x, i: F.when(
            F.array_contains(F.col(chosen), x),
            F.struct(x.alias("print"), i.alias("place"), _around(words, i, length, k).alias("near")),
        ),
    )
    return F.explode(F.filter(found, lambda x: x.isNotNull()))


def _run(equal: Column, length: int) -> Column:
    """How many leading values are true."""
    stop = F.array_position(equal, F.lit(False))
    return F.when(stop == 0, F.lit(length)).otherwise(stop - 1)


def _hits(docs: DataFrame, items: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """For windows of one length: (key, doc_id, n_words, copies) of all documents, and one row per
    meeting that holds a window: key, item_id, first, last."""
    k = min(gram, length)
    reach = length - k
    test = _with_fingerprints(items, "words", length, gram)
    test = save(
        test.select("item_id", _places(test, "words", "prints", length, k).alias("at")).select(
            "item_id", F.col("at.print").alias("print"), F.col("at.near").alias("item_near")
        ),
        "benchmark-prints",
    )
    train = docs.select(row_key("doc_id", "text").alias("key"), "doc_id", words_of("text").alias("words"))
    train = _with_fingerprints(train.withColumn("n_words", F.size("words").cast("long")), "words", length, gram)
    # A row without fingerprint stands for the document itself, so that one pass serves both results.
    lone = F.array(F.lit(None).cast("long"))
    rows = train.select("key", "doc_id", "n_words", F.explode(F.concat(lone, F.col("prints"))).alias("print"))
    known = test.select("print").distinct().withColumn("known", F.lit(True))
    met = rows.join(known, "print", "left").filter(F.col("print").isNull() | F.col("known"))
    found = save(
        met.groupBy("key").agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.count(F.when(F.col("print").isNull(), True)).alias("copies"),
            F.collect_set("print").alias("chosen"),
        ),
        "documents-met",
    )
    chosen = found.filter(F.size("chosen") > 0).select("key", "chosen")
    near = docs.select(row_key("doc_id", "text").alias("key"), "text").join(chosen, "key")
    near = near.select("key", "chosen", words_of("text").alias("words"))
    near = near.withColumn("hashes", F.transform("words", lambda x: F.xxhash64(x)))
    near = with_grams(near, "hashes", "grams", k).drop("hashes")
    near = near.select("key", _places(near, "words", "chosen", length, k).alias("at")).select(
        "key", F.col("at.print").alias("print"), F.col("at.place").alias("place"), F.col("at.near").alias("near")
    )
    both = near.join(test, "print").withColumn(
        "equal", F.zip_with("near", "item_near", lambda a, b: F.coalesce(a == b, F.lit(False)))
    )
    both = both.filter(F.size(F.filter(F.slice("equal", reach + 1, k), lambda x: x)) == k)
    left = _run(F.reverse(F.slice("equal", 1, reach)), reach) if reach else F.lit(0)
    right = _run(F.slice("equal", reach + k + 1, reach), reach) if reach else F.lit(0)
    spans = both.select("key", "item_id", "place", left.alias("left"), right.alias("right"))
    spans = spans.filter(F.col("left") + F.col("right") + k >= length)
    return found, spans.select(
        "key",
        "item_id",
        (F.col("place") - F.col("left")).alias("first"),
        (F.col("place") + k - 1 + F.col("right")).alias("last"),
    )


def shared_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): a row per distinct document with its word count and copies, and every run of
    words, first to last, in which a document holds a window of an item."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item_id).alias("item_id"), words_of(F.col(item_text)).alias("words"))
    items = save(items.filter(F.size("words") > 0), "benchmark-words")
    # At most `window` numbers: one for each window length that occurs.
    lengths = [
        r[0] for r in items.select(F.least(F.size("words"), F.lit(window)).alias("n")).distinct().collect()
    ]
    found, spans = None, None
    for length in sorted(lengths, reverse=True) or [window]:
        of_length = F.size("words") >= window if length == window else F.size("words") == length
        met, hits = _hits(docs, items.filter(of_length), length, gram)
        found = met if found is None else found
        spans = hits if spans is None else spans.unionByName(hits)
    return found.select("key", "doc_id", "n_words", "copies"), spans


def contamination(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, item_ids (sorted as strings), contaminated."""
    found, spans = shared_spans(docs, benchmark, **names)
    per_doc = spans.groupBy("key").agg(
        F.sort_array(F.collect_set(F.struct("first", "last"))).alias("spans"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"),
    )
    # Length of the union of intervals sorted by their start.
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end"))
    union = F.aggregate(
        "spans",
        start,
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(s["first"] - 1, acc["end"]))).cast("long").alias("n"),
            F.greatest(acc["end"], s["last"]).cast("long").alias("end"),
        ),
    )["n"]
    per_doc = per_doc.select("key", union.alias("n_hit"), "item_ids")
    out = found.join(per_doc, "key", "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        "key",
    ).withColumn("contaminated", F.col("n_hit") > 0)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """The documents that share no window with an item, with all their columns."""
    _, spans = shared_spans(docs, benchmark, doc_id=doc_id, text=text, **names)
    bad = save(spans.select(F.col("key").alias("__c_key")).distinct(), "contaminated")
    keyed = docs.select(whole_row(docs).alias("row"), row_key(doc_id, text).alias("__c_key"))
    return keyed.join(bad, "__c_key", "left_anti").select("row.*")
