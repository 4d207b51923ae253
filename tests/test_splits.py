import pytest
from pyspark.sql import functions as F

from tracemill.operators import numbering, splits


@pytest.fixture(scope="module")
def rows(spark):
    # clustered ids with gaps
    return spark.range(3000).select((F.col("id") * F.when(F.col("id") < 1500, 1).otherwise(10**9)).alias("id"))


def _sorted(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("val,test", [(100, 50), (0, 10), (10, 0), (1, 2998), (0, 0)])
def test_three_way_sizes(rows, val, test):
    got = dict(_sorted(splits.split_counts(splits.three_way_split(rows, "id", val, test)), "split", "rows"))
    expected = {"val": val, "test": test, "train": 3000 - val - test}
    assert got == {k: v for k, v in expected.items() if v}


def test_split_ignores_partitioning(rows):
    results = [
        _sorted(splits.three_way_split(rows.repartition(n), "id", 100, 50, seed=5), "id", "split") for n in (1, 4, 200)
    ]
    assert results[0] == results[1] == results[2]
    assert results[0] != _sorted(splits.three_way_split(rows, "id", 100, 50, seed=6), "id", "split")


def test_split_too_large(rows):
    with pytest.raises(Exception, match="smaller than the dataset"):
        splits.three_way_split(rows, "id", 1500, 1500).collect()


def test_sample(rows):
    sample = splits.seeded_sample(rows, "id", 200)
    assert sample.count() == 200 and sample.distinct().count() == 200
    assert _sorted(sample, "id") == _sorted(splits.seeded_sample(rows.repartition(13), "id", 200), "id")
    with pytest.raises(Exception, match="larger than the dataset"):
        splits.seeded_sample(rows, "id", 3001).collect()


@pytest.mark.parametrize(
    "make",
    [lambda d: splits.three_way_split(d, "id", 0, 0), lambda d: splits.seeded_sample(d, "id", 1),
     lambda d: splits.train_test_split(d, "id", 0.5, 1), lambda d: splits.train_test_split(d, "id", 50, 1)],
)
def test_small_tables_fail_at_once(spark, make):
    with pytest.raises(ValueError):
        make(spark.range(0)).select("id")
    if make(spark.range(51)).select("id").count():
        with pytest.raises(ValueError):
            splits.train_test_split(spark.range(10), "id", 50, 1)


def test_shuffle_is_a_permutation(rows):
    shuffled = splits.seeded_shuffle(rows, "id")
    assert [r.position for r in shuffled.orderBy("position").collect()] == list(range(3000))
    # the shuffle and the split agree on the order
    head = shuffled.filter("position < 100").select("id")
    val = splits.three_way_split(rows, "id", 100, 50).filter("split = 'val'").select("id")
    assert _sorted(head, "id") == _sorted(val, "id")


@pytest.mark.parametrize("size", [0, 1, 1499, 1500, 1501, 3000, 5000])
def test_first_rows(rows, size):
    if size == 0:
        assert splits.first_lines(rows, "id", 0).count() == 0
        return
    ids = [r.id for r in rows.orderBy("id").collect()]
    assert [i for (i,) in _sorted(splits.first_rows(rows, "id", size), "id")] == ids[:size]


def test_natural_positions(rows):
    order = numbering.natural_order(rows, "id", buckets=16)
    got = numbering.with_position(rows.repartition(5), order).orderBy("id").collect()
    assert [r.position for r in got] == list(range(3000))


def test_empty_table(rows):
    empty = rows.filter("id < 0")
    assert numbering.with_position(empty, numbering.natural_order(empty, "id")).count() == 0
    assert splits.holdout_split(empty, "id", 5).count() == 0


def test_holdout_and_membership(rows):
    got = dict(_sorted(splits.split_counts(splits.holdout_split(rows, "id", 500)), "split", "rows"))
    assert got == {"valid": 500, "train": 2500}
    chosen = rows.filter("id % 3 = 0").union(rows.filter("id % 3 = 0"))
    parts = splits.membership_split(rows, chosen, "id")
    assert parts.count() == 3000
    assert parts.filter("split = 'in'").filter("id % 3 <> 0").count() == 0
    with_null = rows.union(rows.limit(1).selectExpr("cast(null as bigint)"))
    assert splits.membership_split(with_null, chosen, "id").filter("id is null").first().split == "out"


def test_hardest_keeps_file_order_on_ties(spark):
    df = spark.createDataFrame([(0, 1, 1), (1, 2, 0), (2, 2, 0), (3, 2, 5)], "line int, a int, b int")
    assert [r.line for r in splits.hardest(df, ["a", "b"], "line", 3).collect()] == [3, 1, 2]
