import pytest
from pyspark.sql import functions as F

from tracemill.functions import tokens as K
from tracemill.operators import batches
from tracemill.operators.numbering import natural_order, shuffled_order


@pytest.fixture(scope="module")
def docs(spark):
    return spark.range(1, 300).select(
        F.col("id"), F.transform(F.sequence(F.lit(1), (F.col("id") % 37 + 1).cast("int")), lambda i: i + 100).alias("ids")
    )


def test_windows(docs):
    rows = docs.select("ids", K.random_window("ids", 10, 1, "id").alias("w")).collect()
    for r in rows:
        assert len(r.w) == min(10, len(r.ids))
        assert r.w == list(range(r.w[0], r.w[0] + len(r.w)))
    assert {r.w[0] for r in rows if len(r.ids) == 11} == {101, 102}


@pytest.mark.parametrize("ratio", [0.0, 0.5, 1.0])
def test_window_and_rest(docs, ratio):
    rows = docs.select("ids", K.window_and_rest("ids", 10, ratio, 1, "id").alias("c")).select("ids", "c.*").collect()
    for r in rows:
        assert 1 <= len(r.head) <= 10
        if r.tail or ratio == 1.0:
            assert r.head + r.tail == r.ids[r.ids.index(r.head[0]) :]
        if len(r.ids) <= 10:
            assert r.head[0] == 101
    assert any(r.tail for r in rows) == (ratio > 0)


@pytest.mark.parametrize("count", [1, 2, 3, 7])
def test_segments_rebuild_the_input(docs, count):
    rows = docs.select("ids", K.segments("ids", count).alias("s")).collect()
    assert all(sum(r.s, []) == r.ids and all(r.s) for r in rows)


def test_segment_sizes(spark):
    ids = F.sequence(F.lit(1), F.lit(10))
    got = spark.range(1).select(K.segments(ids, 3).alias("s"), K.segment_count(ids, 3, 2).alias("n")).first()
    assert [len(s) for s in got.s] == [4, 4, 2] and got.n == 2


def test_assembled_rows(spark):
    df = spark.createDataFrame([([11, 12],)], "a array<int>")
    row = df.select(K.autoencoding_row("a", [7, 8, 9], 3, 2).alias("r")).first().r
    assert row.labels == [-100] * 4 + [11, 12, 2] and row.prompt_answer_ids == [7, 8, 9, 3, 11, 12, 2]
    for leave, task in ((1, None), (5, None), (1, 4)):
        row = df.select(K.continuation_row("a", 3, 7, leave, task).alias("r")).first().r
        assert len(row.labels) == len(row.prompt_answer_ids) == 5 + (task is not None)
        assert row.labels[-2:] == ([-100, 12] if leave == 1 else [-100, -100])


def test_pad_size(spark):
    assert spark.range(1).select(K.round_up(F.lit(5), 4)).first()[0] == 8
    assert spark.range(1).select(K.round_up(F.lit(8), 4)).first()[0] == 8


@pytest.mark.parametrize("multiple", [None, 8])
@pytest.mark.parametrize("shuffled", [False, True])
def test_batches(docs, multiple, shuffled):
    order = shuffled_order("id", 4) if shuffled else natural_order(docs, "id")
    got = batches.pad_batches(docs, "id", order, {"ids": 0}, 16, multiple).collect()
    assert len(got) == 299
    by_batch = {}
    for r in got:
        by_batch.setdefault(r.batch_id, []).append(r)
    assert sorted(by_batch) == list(range(19)) and all(len(b) == 16 for k, b in by_batch.items() if k < 18)
    for rows in by_batch.values():
        longest = max(sum(i != 0 for i in r.ids) for r in rows)
        size = longest if not multiple else -(-longest // multiple) * multiple
        assert {len(r.ids) for r in rows} == {size}
        assert sorted(r.batch_row for r in rows) == list(range(len(rows)))
    if not shuffled:
        assert all(r.id == r.batch_id * 16 + r.batch_row + 1 for r in got)


def test_condition_dropout(spark):
    df = spark.createDataFrame([([1, 2, 3, 5, 6],), ([1, 5, 6],), ([1, 2, 3],), ([5, 1],)], "i array<int>")
    got = [r.d for r in df.select(K.drop_condition("i", 5, 9, 1, F.lit(0), prob=1.1).alias("d")).collect()]
    assert got == [[1, 9, 9, 5, 6], [1, 5, 6], [1, 2, 3], [5, 1]]
    kept = [r.d for r in df.select(K.drop_condition("i", 5, 9, 1, F.lit(0), prob=0.0).alias("d")).collect()]
    assert kept[0] == [1, 2, 3, 5, 6]


def test_tokenizer_is_given_a_few_characters_at_a_time(spark):
    from tracemill.operators import hooks

    def factory():
        return lambda texts: [None if t is None else [len(texts), len(t)] for t in texts]

    df = spark.createDataFrame([(i, None if i == 3 else "x" * (100 if i == 5 else 4)) for i in range(8)], "i int, t string").coalesce(1)
    got = [r.ids for r in df.select("i", hooks.tokenize("t", factory, most_chars=8).alias("ids")).orderBy("i").collect()]
    assert got == [[2, 4], [2, 4], [3, 4], None, [3, 4], [1, 100], [2, 4], [2, 4]]
