"""Queries that split, shuffle, sample and count documents and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import splits
from . import inputs, oracle as O
from .registry import query

VAL, TEST, HOLDOUT, SAMPLE, HEAD, SEED = 60, 40, 50, 150, 170, 42


def _ranked(relation: str, key: str, seed: int = SEED) -> str:
    return f"(select *, row_number() over (order by {O.digest(str(seed), key)}, {key}) - 1 as position from {relation})"


_SPLIT = f"case when position < {VAL} then 'val' when position < {VAL + TEST} then 'test' else 'train' end"


@query(f"select doc_id, md5(text) as text, {_SPLIT} as split from {_ranked('documents', 'doc_id')}")
def exact_split(spark, sf_dir):
    """Every document with its train, val or test label."""
    df = splits.three_way_split(inputs.table(spark, sf_dir, "documents"), "doc_id", VAL, TEST, SEED)
    return df.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text"), "split")


@query(f"select split, count(*) as rows from (select {_SPLIT} as split from {_ranked('orders', 'o_orderkey')}) group by split")
def split_counts(spark, sf_dir):
    """Row counts of a three-way split of the orders."""
    df = splits.three_way_split(inputs.table(spark, sf_dir, "orders"), "o_orderkey", VAL, TEST, SEED)
    return splits.split_counts(df)


@query(
    f"""select o_orderkey, case when position < {HOLDOUT} then 'valid' else 'train' end as split
    from {_ranked('orders', 'o_orderkey')}"""
)
def holdout_split(spark, sf_dir):
    """Validation hold-out of the orders."""
    df = splits.holdout_split(inputs.table(spark, sf_dir, "orders"), "o_orderkey", HOLDOUT, SEED)
    return df.select("o_orderkey", "split")


@query(
    f"""select doc_id, case when position < ceil(total * 0.1) then 'test' else 'train' end as split
    from {_ranked('documents', 'doc_id', 7)}, (select count(*) as total from documents)"""
)
def two_way_split(spark, sf_dir):
    """A tenth of the documents as test."""
    return splits.train_test_split(inputs.table(spark, sf_dir, "documents"), "doc_id", 0.1, 7).select("doc_id", "split")


@query(f"select o_orderkey, position from {_ranked('orders', 'o_orderkey')}")
def seeded_shuffle(spark, sf_dir):
    """Shuffled position of every order."""
    return splits.seeded_shuffle(inputs.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", SEED)


@query(f"select doc_id, lang from {_ranked('documents', 'doc_id')} where position < {SAMPLE}")
def seeded_sample(spark, sf_dir):
    """A fixed-size sample of the documents."""
    return splits.seeded_sample(inputs.table(spark, sf_dir, "documents"), "doc_id", SAMPLE, SEED).select("doc_id", "lang")


@query(
    f"""with numbered as (select doc_id, 2 * doc_id + case when lang = 'en' then 1 else 0 end as line_id from documents)
    select 'rows' as counted, doc_id from (select * from numbered order by line_id limit {HEAD})
    union all select 'lines', doc_id from numbered where line_id < {HEAD}"""
)
def first_n(spark, sf_dir):
    """The first documents of a file with blank lines between them, counting rows and counting lines."""
    line = 2 * F.col("doc_id") + F.when(F.col("lang") == "en", 1).otherwise(0)
    numbered = inputs.table(spark, sf_dir, "documents").select("doc_id", line.alias("line_id"))
    rows = splits.first_rows(numbered, "line_id", HEAD).select(F.lit("rows").alias("counted"), "doc_id")
    lines = splits.first_lines(numbered, "line_id", HEAD).select(F.lit("lines").alias("counted"), "doc_id")
    return rows.unionByName(lines)


@query(
    """select doc_id, case when doc_id in (select doc_id from labels where quality = 1) then 'in' else 'out' end as split
    from documents"""
)
def membership_split(spark, sf_dir):
    """Documents with and without a good-quality label."""
    chosen = inputs.table(spark, sf_dir, "labels").filter("quality = 1")
    df = splits.membership_split(inputs.table(spark, sf_dir, "documents"), chosen, "doc_id")
    return df.select("doc_id", "split")
