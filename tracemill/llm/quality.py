"""Quality rules: statistics of each text and the frequency of its lines across documents of a host.

Lines are normalised and hashed; a line's frequency is the number of distinct texts of one host that
hold it, so exact copies of a document count once. Lines above the limit are removed: `keep_good` cuts
them out of the texts, and rejects documents that have too little left. `judge` only reports,
and both take a text's statistics before the cut. Only built-in expressions are used. What is counted
are hashes of lines; documents look up their verdict and their frequent lines by a key.

Nulls and edges: a null or blank text has no words and fails; a null host is a host of its own; rows
that repeat are judged alike, each keeping its own row; other columns are not looked at, and keep their names
and values; a very long text is judged whole, in its own task; a line at the limit exactly (a tie) stays; an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE_GAP, SPACES, row_key, save, split_words, whole_row, with_grams

REPEAT_WINDOW = 8


@dataclass(frozen=True)
class Limits:
    min_words: int = 20
    max_repeat_percent: int = 30
    #: A line is removed when more texts of its host than both of these hold it.
    line_documents: int = 100
    line_percent: int = 5
    #: A document is depleted when fewer words than this, and than this share, are left.
    left_words: int = 5
    left_percent: int = 20


def with_text_stats(df: DataFrame, text: str) -> DataFrame:
    """Append n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text column."""
    t = F.coalesce(F.col(text), F.lit(""))
    w, h, g, s, p = (f"__{x}" for x in ("words", "hashes", "grams", "sorted", "places"))
    out = (
        df.withColumn(w, split_words(t, SPACE_GAP))
        .withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
        .withColumn("n_words", F.size(w).cast("long"))
        .withColumn("word_chars", F.length(F.translate(t, SPACES, "")).cast("long"))
        .withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"))
        .withColumn("__lines", F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
        .drop(w, "__lines")
    )
    out = with_grams(out, h, g, REPEAT_WINDOW)
    repeats = F.size(g) > F.size(F.array_distinct(g))
    # Equal windows meet when sorted with their places; only texts that have some are sorted.
    order = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    out = out.withColumn(s, F.when(repeats, order)).drop(h, g)
    met = F.transform(
        F.sequence(F.lit(0), F.size(s) - 1),
        lambda j: F.when(
            (F.get(F.col(s), j)["x"] == F.get(F.col(s), j - 1)["x"])
            | (F.get(F.col(s), j)["x"] == F.get(F.col(s), j + 1)["x"]),
            F.get(F.col(s), j)["i"],
        ),
    )
    out = out.withColumn(p, F.when(F.col(s).isNotNull(), F.sort_array(F.filter(met, lambda x: x.isNotNull())))).drop(s)
    steps = F.zip_with(
        F.col(p),
        F.slice(p, 2, F.size(p)),
        lambda a, b: F.least(F.lit(REPEAT_WINDOW), F.coalesce(b - a, F.lit(REPEAT_WINDOW))),
    )
    covered = F.aggregate(steps, F.lit(0), lambda total, x: total + x)
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop(p)


def base_failed(limits: Limits) -> Column:
    words = F.col("n_words")
    return (words < limits.min_words) | (
        F.col("n_repeat_words") * 100 > words * limits.max_repeat_percent
    )


def document_lines(docs: DataFrame, key: Column, text: str, host: str) -> DataFrame:
    """One row per line with a word: key, host, hash of the text, words of the text, hash and words of
    the normalised line (lower case, single spaces)."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = docs.select(
        key.alias("key"),
        F.col(host).cast("string").alias("host"),
        F.xxhash64(t).alias("text_hash"),
        F.explode(F.split(F.lower(t), "\n")).alias("line"),
    ).withColumn("line", F.btrim(F.regexp_replace("line", SPACE_GAP, " "), F.lit(" ")))
    return lines.filter("line <> ''").select(
        "key",
        "host",
        "text_hash",
        F.xxhash64("line").alias("line_hash"),
        (F.length("line") - F.length(F.translate("line", " ", "")) + 1).alias("line_words"),
    )


def frequent_lines(lines: DataFrame, limits: Limits) -> DataFrame:
    """(host, line_hash, documents) of the lines that too many distinct texts of a host hold."""
    held = lines.groupBy("host", "line_hash", "text_hash").agg(F.lit(1).alias("one"))
    counts = held.groupBy("host", "line_hash").agg(F.count(F.lit(1)).alias("documents"))
    counts = counts.filter(F.col("documents") > limits.line_documents)
    sizes = (
        lines.groupBy("host", "text_hash").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    )
    at = counts.alias("c").join(sizes.alias("s"), F.col("c.host").eqNullSafe(F.col("s.host")))
    return at.filter(F.col("documents") * 100 > F.col("of") * limits.line_percent).select(
        "c.host", "line_hash", "documents"
    )


def touched_documents(
    docs: DataFrame, key: Column, text: str = "text", host: str = "source", limits: Limits = Limits()
) -> DataFrame:
    """Keys of the documents that hold frequent lines of their host: depleted, whether they lose nearly all
    their words with them, left, the words they keep, and frequent, the hashes of these lines."""
    lines = save(document_lines(docs, key, text, host), "lines")
    frequent = save(frequent_lines(lines, limits), "frequent-lines")
    hit = (F.col("l.line_hash") == F.col("f.line_hash")) & F.col("l.host").eqNullSafe(F.col("f.host"))
    # A document of which no line is frequent drops out here; the others are summed whole.
    flagged = (
        lines.alias("l").join(frequent.alias("f"), hit, "left").select(
            "key", "line_words", F.col("documents").isNotNull().alias("gone"), F.col("l.line_hash").alias("line_hash")
        )
    )
    totals = flagged.groupBy("key").agg(
        F.sum("line_words").alias("words"),
        F.sum(F.when(F.col("gone"), F.col("line_words"))).alias("gone"),
        F.collect_set(F.when(F.col("gone"), F.col("line_hash"))).alias("frequent"),
    )
    left = F.col("words") - F.col("gone")
    depleted = (left < limits.left_words) & (left * 100 < F.col("words") * limits.left_percent)
    return totals.filter("gone is not null").select(
        "key", depleted.alias("depleted"), left.alias("left"), "frequent"
    )


def without_lines(text: Column, hashes: Column) -> Column:
    """The text without the lines whose normalised form has one of the hashes."""
    plain = lambda x: F.btrim(F.regexp_replace(F.lower(x), SPACE_GAP, " "), F.lit(" "))
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(hashes, F.xxhash64(plain(x)))), "\n")


def judge(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", limits: Limits = Limits()
) -> DataFrame:
    """doc_id, the statistics, base_failed, depleted and kept, a row per row."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(host).alias("host"))
    key = row_key("doc_id", "host", "text")
    gone = save(touched_documents(plain, key, "text", "host", limits).filter("depleted").select("key", "depleted"), "depleted")
    stats = with_text_stats(plain.withColumn("key", key), "text").drop("text", "host")
    out = stats.join(gone, "key", "left").withColumn("base_failed", base_failed(limits))
    return (
        out.withColumn("depleted", F.coalesce("depleted", F.lit(False)))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
        .drop("key")
    )


#: Bits of the map of touched documents: 2^23, a megabyte, whatever the corpus.
_MAP_WORDS = 1 << 17


def _may_hold(keys: DataFrame, key: Column) -> Column:
    """Whether a key is in `keys` or shares its bit with one that is: a map of fixed size, made by the query."""
    bit = lambda k: F.pmod(k["a"], F.lit(64 * _MAP_WORDS))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit(F.col("key")), F.lit(64)).cast("int"))
    word = F.call_function("div", bit(F.col("key")), F.lit(64))
    words = keys.groupBy(word.alias("word")).agg(F.bit_or(mask).alias("bits"))
    every = keys.sparkSession.range(_MAP_WORDS).join(words, F.col("id") == F.col("word"), "left")
    listed = every.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("all"))
    found = F.get(listed.select(F.transform("all", lambda x: x["bits"])).scalar(), F.call_function("div", bit(key), F.lit(64)).cast("int"))
    return F.call_function("getbit", found, F.pmod(bit(key), F.lit(64)).cast("int")) == 1


def keep_good(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", limits: Limits = Limits()
) -> DataFrame:
    """The documents that pass, with all their columns; frequent lines are cut out of their texts. A document must
    pass before the cut, and after it hold `min_words` words or more and not be depleted. Only documents that
    may hold frequent lines are joined with these; the others stay where they are read."""
    key = row_key(doc_id, host, text)
    touched = save(touched_documents(docs, key, text, host, limits), "touched")
    keyed = docs.select(whole_row(docs).alias("row"), F.col(text).alias("text"), key.alias("key"))
    keyed = keyed.withColumn("may", _may_hold(touched.select("key"), F.col("key")))

    def passing(some: DataFrame) -> DataFrame:
        # A filter on the statistics would be pushed through their projections by substitution, and compute
        # arrays again for each of their elements. It is not pushed past a column that depends on the row's place.
        stats = with_text_stats(some, "text").withColumn("place", F.monotonically_increasing_id())
        return stats.filter(~base_failed(limits) & (F.col("place") >= 0)).select("row", "key")

    def rows(some: DataFrame, cut: Column) -> DataFrame:
        return some.select(*[(cut if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])

    old = F.col(f"row.`{text}`")
    met = passing(keyed.filter("may")).join(touched, "key", "left")
    left = met.filter(F.col("frequent").isNull() | (~F.col("depleted") & (F.col("left") >= limits.min_words)))
    cut = F.when(F.col("frequent").isNotNull(), without_lines(old, F.col("frequent"))).otherwise(old)
    return rows(passing(keyed.filter("not may")), old).unionByName(rows(left, cut))
