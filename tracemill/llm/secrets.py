"""Secret scans: candidates by pattern, told apart by who else holds the same value.

A value that many distinct repositories and owners hold was copied from a manual or an example; one
that few hold looks like somebody's live credential. Candidate hashes are aggregated over the whole
corpus for that. Only built-in expressions are used; texts are not shuffled to find spans.

Nulls and edges: a null text is empty; a null owner or repository counts as one value; rows that
repeat are judged alike, each keeping its own row; other columns are not looked at, whatever their names. A
text is searched whole, as one row, whatever its length; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import row_key, save, whole_row


@dataclass(frozen=True)
class Kind:
    """A pattern whose matches count from left to right without overlap; those whose `group` is shorter
    than `at_least` drop out afterwards. `always` keeps a match even if many owners hold its value."""

    name: str
    pattern: str
    group: int
    at_least: int
    always: bool


KINDS = (
    Kind("assign", r"(?:(?i)(?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6, True),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    # Whole runs of 24 and more: the same as runs of any length of which shorter ones are dropped.
    Kind("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Kind(
        "provider",
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----|gh[opsur]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}"
        r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,}",
        0,
        0,
        False,
    ),
)
#: A value is a copied example when it has at least so many owners and repositories.
EXAMPLE_OWNERS = 5
EXAMPLE_REPOSITORIES = 5
CHUNK = 256


def _starts(df: DataFrame, text: str, kind: Kind) -> DataFrame:
    """Append `kind.name`: array of (start, end, value hash) in code points. Matches and the pieces
    between them give the places; sums over chunks keep that from growing with their square."""
    m, pieces, lens, sums = (f"__{x}" for x in ("matches", "pieces", "lengths", "sums"))
    found = F.regexp_extract_all(F.col(text), F.lit(kind.pattern), F.lit(0))
    df = df.withColumn(m, found)
    some = F.size(m) > 0
    value = F.regexp_extract_all(F.col(text), F.lit(kind.pattern), F.lit(kind.group)) if kind.group else F.col(m)
    df = df.withColumn("__values", F.when(some, value))
    df = df.withColumn(pieces, F.when(some, F.transform(F.split(text, kind.pattern), lambda x: F.length(x))))
    df = df.withColumn(
        lens,
        F.transform(m, lambda x, i: (F.get(F.col(pieces), i) + F.length(x)).cast("long")),
    )
    zero = F.lit(0).cast("long")
    total = lambda a: F.aggregate(a, zero, lambda x, y: x + y)
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / CHUNK).cast("int")),
        lambda c: total(F.slice(F.col(lens), c * CHUNK + 1, F.lit(CHUNK))),
    )
    df = df.withColumn(sums, F.when(some, chunks))

    def span(x, i):
        c = F.floor(i / CHUNK).cast("int")
        before = total(F.slice(F.col(sums), F.lit(1), c)) + total(F.slice(F.col(lens), c * CHUNK + 1, i - c * CHUNK))
        start = before + F.get(F.col(pieces), i)
        kept = F.length(F.get(F.col("__values"), i)) >= kind.at_least
        return F.when(
            kept,
            F.struct(
                start.alias("start"),
                (start + F.length(x)).alias("end"),
                F.xxhash64(F.get(F.col("__values"), i)).alias("value"),
            ),
        )

    spans = F.filter(F.transform(m, span), lambda x: x.isNotNull())
    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:bigint>>")
    return df.withColumn(kind.name, F.when(some, spans).otherwise(empty)).drop(m, pieces, lens, sums, "__values")


def find_candidates(docs: DataFrame, doc_id: str, text: str, owner: Column, repository: Column) -> DataFrame:
    """Per row: key, doc_id, owner, repository and one array of spans per kind; no text."""
    out = docs.select(
        row_key(doc_id, text, owner, repository).alias("key"),
        F.col(doc_id).alias("doc_id"),
        owner.cast("string").alias("owner"),
        repository.cast("string").alias("repository"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    for kind in KINDS:
        out = _starts(out, "text", kind)
    return out.drop("text")


def copied_values(found: DataFrame) -> DataFrame:
    """Hashes of the values that many owners and repositories hold. Grouping in steps keeps a value that
    a third of all documents hold from meeting in one task."""
    values = F.array_distinct(F.flatten(F.array(*[F.transform(k.name, lambda s: s["value"]) for k in KINDS])))
    rows = found.select("owner", "repository", F.explode(values).alias("value"))
    rows = rows.groupBy("value", "owner", "repository").agg(F.lit(1).alias("one"))
    rows = rows.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    rows = rows.groupBy("value").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories")
    )
    return rows.filter(
        (F.col("owners") >= EXAMPLE_OWNERS) & (F.col("repositories") >= EXAMPLE_REPOSITORIES)
    ).select("value")


def judged_spans(found: DataFrame) -> DataFrame:
    """Per key that has candidates: array `judged` of (start, kind number, end, example), in order."""
    copied = save(copied_values(found), "copied-values").withColumn("copied", F.lit(True))
    def of_kind(number: int):
        return lambda s: F.struct(
            s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"), s["value"].alias("value")
        )

    each = F.flatten(F.array(*[F.transform(k.name, of_kind(n)) for n, k in enumerate(KINDS)]))
    rows = found.select("key", F.explode(each).alias("s")).select("key", "s.*").join(copied, "value", "left")
    one = F.struct("start", "kind", "end", F.coalesce("copied", F.lit(False)).alias("example"))
    return rows.groupBy("key").agg(F.sort_array(F.collect_set(one)).alias("judged"))


def _owner(owner) -> Column:
    return owner if isinstance(owner, Column) else F.col(owner)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner="source", repository=None) -> DataFrame:
    """Per row: doc_id, n_<kind> of each kind, `base` and `spans` (kind, start, end; the latter with the
    added kinds that are no copied examples), n_live and n_example. Without a repository column the
    owner's documents are taken for repositories."""
    owner = _owner(owner)
    repository = F.col(doc_id) if repository is None else _owner(repository)
    found = save(find_candidates(docs, doc_id, text, owner, repository), "candidates")
    judged = save(judged_spans(found), "judged")
    out = found.join(judged, "key", "left")
    judged_or_none = F.coalesce("judged", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,example:boolean>>"))
    base = [n for n, k in enumerate(KINDS) if k.always]
    return out.select(
        "doc_id",
        *[F.size(k.name).cast("long").alias(f"n_{k.name}") for k in KINDS],
        F.filter(judged_or_none, lambda s: s["kind"].isin(base)).alias("base"),
        F.filter(judged_or_none, lambda s: s["kind"].isin(base) | ~s["example"]).alias("spans"),
        F.size(F.filter(judged_or_none, lambda s: ~s["example"])).cast("long").alias("n_live"),
        F.size(F.filter(judged_or_none, lambda s: s["example"])).cast("long").alias("n_example"),
    )


def spans_text(spans) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner="source", repository=None, mask: str = "<SECRET>") -> DataFrame:
    """The documents with every live-looking span masked; copied examples stay as they are. All
    columns are returned; only the text changes."""
    owner = _owner(owner)
    repository = F.col(doc_id) if repository is None else _owner(repository)
    found = save(find_candidates(docs, doc_id, text, owner, repository), "candidates")
    judged = save(judged_spans(found), "judged")
    live = judged.select("key", F.filter("judged", lambda s: ~s["example"]).alias("__s_spans"))
    live = live.filter(F.size("__s_spans") > 0)
    keyed = docs.select(whole_row(docs).alias("row"), row_key(doc_id, text, owner, repository).alias("key"))
    joined = keyed.join(live, "key", "left")
    t = F.col("row")[text]
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("end"))
    masked = F.aggregate(
        "__s_spans",
        start,
        lambda acc, s: F.struct(
            F.when(
                s["start"] >= acc["end"],
                F.concat(acc["done"], F.substring(t, acc["end"].cast("int") + 1, (s["start"] - acc["end"]).cast("int")), F.lit(mask)),
            ).otherwise(acc["done"]).alias("done"),
            F.greatest(acc["end"], s["end"]).alias("end"),
        ),
        lambda acc: F.concat(acc["done"], F.substring(t, acc["end"].cast("int") + 1, F.length(t))),
    )
    changed = F.when(F.col("__s_spans").isNull(), t).otherwise(masked)
    return joined.select(*[changed.alias(text) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
