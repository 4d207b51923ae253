import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.functions import vectors as V
from tracemill.operators import diversity, evaluate, hooks, latents, rollouts
from tracemill.operators.numbering import natural_order


def test_best_of_n_first_on_ties(spark):
    df = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.9), (1, 2, 0.9), (2, 0, 0.1)], "example_id int, rollout_id int, reward double")
    got = sorted((r.example_id, r.rollout_id) for r in rollouts.best_of_n(df).collect())
    assert got == [(1, 1), (2, 0)]


def test_last_step_reward(spark):
    log = spark.range(2000).select(
        (F.col("id") % 2).alias("example_id"), F.lit(0).alias("rollout_id"), F.floor(F.col("id") / 2).alias("step_id")
    ).withColumn("reward", (F.col("step_id") == 999).cast("double") * (F.col("example_id") + 1))
    got = rollouts.last_step_reward(log).groupBy("example_id").agg(
        F.count("*").alias("n"), F.min("lst_reward").alias("lo"), F.max("lst_reward").alias("hi")
    )
    assert sorted(map(tuple, got.collect())) == [(0, 1000, 1.0, 1.0), (1, 1000, 2.0, 2.0)]


@pytest.mark.parametrize("ragged", [False, True])
def test_shards_are_dense(spark, ragged):
    examples = spark.range(0, 700, 7).withColumnRenamed("id", "example_id")
    facts = rollouts.cross_rollouts(rollouts.with_example_rank(examples), 8, 50)
    if ragged:
        facts = facts.filter("(example_id + step_id) % 5 <> 1").drop("example_rank")
        placed = rollouts.assign_shards_ragged(facts, 8, 51)
    else:
        placed = rollouts.assign_shards(facts, 8, 51)
    total = placed.count()
    rows = placed.orderBy("example_id", "rollout_id", "step_id").select("shard", "row").collect()
    assert [(r.shard, r.row) for r in rows] == [(f"latents-{i // 4096:06d}", i % 4096) for i in range(total)]


def test_grid(spark):
    steps = spark.range(1).select(V.timestep_grid(50).alias("t"), V.sigma_grid(4).alias("s"), V.timestep_grid(1).alias("one")).first()
    assert steps.t[:3] == [999, 978, 958] and steps.t[-3:] == [40, 20, 0]
    assert steps.s == [1.0, 0.75, 0.5, 0.25, 0.0] and steps.one == [999]


@pytest.mark.parametrize("chunk", [1, 2, 3, 64])
def test_velocity_in_chunks(spark, chunk):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(11, 3))
    df = spark.createDataFrame([(1, 0, i, [float(x) for x in v]) for i, v in enumerate(z)], "example_id int, rollout_id int, step_id int, latent array<double>")
    got = latents.step_velocity(df, 10, chunk=chunk).orderBy("step_id").collect()
    assert len(got) == 11 and got[-1].velocity is None
    expected = (z[:-1] - z[1:]) * 10
    assert np.allclose([r.velocity for r in got[:-1]], expected)
    assert np.allclose([r.velocity_norm for r in got[:-1]], np.linalg.norm(expected, axis=1))


def _vectors(spark, sizes, dim=5):
    rng = np.random.default_rng(3)
    groups = {g: np.round(rng.normal(size=(n, dim)), 3) for g, n in sizes.items()}
    groups["same"] = np.ones((40, dim))
    groups["twins"] = np.repeat(np.round(rng.normal(size=(15, dim)), 3), 2, axis=0)
    rows = [(g, i, [float(x) for x in v]) for g, z in groups.items() for i, v in enumerate(z)]
    return groups, spark.createDataFrame(rows, "g string, i int, v array<double>").repartition(7)


@pytest.mark.parametrize("block", [4, 16, 256])
def test_diversity_against_brute_force(spark, block):
    groups, df = _vectors(spark, {"one": 1, "few": 4, "some": 17, "many": 90})
    medians = {r.g: r.bandwidth for r in diversity.median_bandwidth(df, ["g"], "i", "v", block=block).collect()}
    grads = {(r.g, r.i): r.grad for r in diversity.repulsion(df, ["g"], "i", "v", dim=5, block=block).collect()}
    assert set(medians) == set(groups) and len(grads) == sum(map(len, groups.values()))
    for g, z in groups.items():
        diff = z[:, None] - z[None]
        d2 = (diff**2).sum(-1)
        upper = np.sort(np.sqrt(d2)[np.triu_indices(len(z), 1)])
        positive = upper[upper > 0]
        if not len(positive):
            assert medians[g] is None
            assert all(not np.any(grads[g, i]) for i in range(len(z)))
            continue
        sigma = positive[(len(positive) - 1) // 2] + 1e-6
        assert medians[g] == pytest.approx(sigma, abs=1e-12)
        w = np.exp(-d2 / sigma**2) * (1 - d2 / sigma**2)
        expected = 2 * (w[..., None] * diff).sum(1)
        assert np.allclose([grads[g, i] for i in range(len(z))], expected, atol=1e-9)


def test_fixed_sigma(spark):
    groups, df = _vectors(spark, {"many": 30})
    small = {(r.g, r.i): r.grad for r in diversity.repulsion(df, ["g"], "i", "v", 5, sigma=0.7).collect()}
    tiled = {(r.g, r.i): r.grad for r in diversity.repulsion(df, ["g"], "i", "v", 5, sigma=0.7, block=8).collect()}
    assert small.keys() == tiled.keys()
    assert all(np.allclose(small[k], tiled[k]) for k in small)


def test_scorer_metrics(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 0.0), (-3.0, 0.0)], "logit double, label double")
    m = evaluate.scorer_metrics(df).first()
    assert m.loss == pytest.approx((np.log(2) + np.log1p(np.exp(2)) + np.log1p(np.exp(-3))) / 3)
    assert (m.accuracy, m.positive_rate) == (pytest.approx(2 / 3), pytest.approx(1 / 3))
    assert tuple(evaluate.scorer_metrics(df.filter("logit > 9")).first()) == (0.0, 0.0, 0.0)


def test_exact_match_denominator(spark):
    df = spark.createDataFrame([(0, "a", "a"), (1, "a\nb\nc\nd", "b\nc\nd"), (2, "x", "y")], "line_id long, input string, output string")
    whole = evaluate.exact_match_metrics(evaluate.with_text_match(df)).first()
    tail = evaluate.exact_match_metrics(evaluate.with_text_match(df, tail=3)).first()
    assert tuple(whole) == (pytest.approx(1 / 3), 1 / 200) and tuple(tail) == (pytest.approx(2 / 3), 2 / 200)


def test_ground_truth_rows(spark):
    log = spark.createDataFrame([(1, 999.0, "t", 0.0, 1.0)], "example_id int, timestep double, text string, reward double, lst_reward double")
    truth = spark.createDataFrame([(1, "g", 1.0)], "example_id int, text string, reward double")
    got = sorted((r.is_gt, r.timestep, r.lst_reward) for r in rollouts.with_ground_truth(log, truth).collect())
    assert got == [(False, 999.0, 1.0), (True, None, 1.0)]


def test_clip(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([float("nan"), float("inf")],), ([0.3, None],)], "v array<double>")
    got = df.select(V.clip_to_norm("v", 1.0).alias("c")).select("c.*").collect()
    assert np.allclose([r.norm for r in got], [5.0, 1e-6, 0.3])
    assert np.allclose([r.clipped for r in got], [[0.6, 0.8], [0, 0], [0.3, 0]])
    off = df.select(V.clip_to_norm("v", 0.0)["clipped"].alias("c")).first().c
    assert off == [3.0, 4.0]


def test_noise_is_normal_and_ignores_partitioning(spark):
    df = spark.range(2000).select("id", V.noise_like(F.array_repeat(F.lit(0.0), 5), 1, "id").alias("n"))
    z = np.array([r.n for r in df.orderBy("id").collect()])
    again = np.array([r.n for r in df.repartition(9).orderBy("id").collect()])
    assert z.shape == (2000, 5) and (z == again).all()
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03


def test_last_reward_keeps_null_keys(spark):
    log = spark.createDataFrame([(1, 0, 0, 0.5), (1, 0, 1, 1.0), (None, 0, 0, 0.25)], "example_id int, rollout_id int, step_id int, reward double")
    got = rollouts.last_step_reward(log).collect()
    assert sorted((r.example_id or 0, r.step_id, r.lst_reward) for r in got) == [(0, 0, 0.25), (1, 0, 1.0), (1, 1, 1.0)]


def test_records_keep_their_types(spark):
    from tracemill.operators import hooks

    df = spark.createDataFrame([(2**53 + 1, "a"), (None, None)], "n bigint, t string")
    got = hooks.map_rows(df, lambda r, by: {"n": None if r["n"] is None else r["n"] + by, "t": r["t"]}, "n bigint, t string", by=1)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(2**53 + 2, "a"), (None, None)], key=str)


def test_generator_sees_whole_examples(spark):
    class Count:
        def __init__(self):
            self.seen = []

        def add(self, row):
            self.seen.append((row.rollout_id, row.step_id))
            return [(row.example_id, "row", len(self.seen))] if row.step_id == 0 else []

        def finish(self):
            yield None, ",".join(f"{a}.{b}" for a, b in self.seen), len(self.seen)

    rows = [(e, r, s, "unused") for e in (1, None) for r in (1, 0) for s in (1, 0)] + [(2, r, 0, "x") for r in range(5000)]
    df = spark.createDataFrame(rows, "example_id int, rollout_id int, step_id int, other string").repartition(5)
    made = hooks.generator_per_example(Count, "example_id int, what string, n int")
    got = made(df.asTable()).collect()
    assert sorted((r.n, r.what) for r in got if r.what != "row" and r.n < 5000) == [(4, "0.0,0.1,1.0,1.1")] * 2
    assert [r.n for r in got if r.what != "row" and r.n > 4] == [5000]
    assert sorted(r.n for r in got if r.what == "row" and r.example_id == 2) == list(range(1, 5001))
    with pytest.raises(Exception, match="needs the columns"):
        made(df.drop("step_id").asTable()).collect()


def test_generator_gets_packed_rows_one_by_one(spark):
    class Sum:
        def __init__(self):
            self.rows = []

        def add(self, row):
            self.rows.append((row.rollout_id, row.step_id, row.what))
            return [(row.example_id, "row", len(self.rows))] if row.step_id == 9 else ()

        def finish(self):
            return [(None, str(self.rows), len(self.rows))]

    rows = [(e, r, s, None if s == 2 else [f"{r}"], 7) for e in (1, None) for r in (2, None, 1) for s in (3, 2, 9)] + [(2, 0, 9, ["x"], 7)]
    df = spark.createDataFrame(rows * 2, "example_id int, rollout_id int, step_id int, what array<string>, other int").repartition(5)
    made = hooks.generator_per_example(Sum, "example_id int, what string, n int", needs=("what",))
    key = lambda x: str(tuple(x))
    want = sorted(made(df.asTable()).collect(), key=key)
    for most in (1, 4, 1024):
        packed = hooks.pack_rows(df, needs=("what",), most=most)
        assert packed.count() == 2 * -(-18 // most) + -(-2 // most) and "other" not in packed.columns
        assert sorted(made(packed.asTable()).collect(), key=key) == want
    with pytest.raises(Exception, match="needs the columns"):
        made(hooks.pack_rows(df).asTable()).collect()


def test_partitioned_generator_is_sent_packed_rows(spark):
    import __spark_entry__ as entry

    plan = physical(entry.queries()["rollout_udtf_partitioned"](spark, "/root/testdata/sf0.001"))
    assert "collect_list" in plan.split("PythonUDTF")[1]
    dealt = [x for x in plan.split("\n") if " Exchange hashpartitioning" in x and "REPARTITION_BY_NUM" not in x]
    assert not dealt  # what lies by example stays


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_grading_broadcasts_neither_side(spark):
    examples = spark.createDataFrame([(1, ["4"]), (2, [None, "7"])], "example_id long, target array<string>")
    texts = spark.createDataFrame([(1, "so 4"), (1, "5"), (2, "#### 7.0"), (3, "1")], "example_id long, final_text string")
    graded = rollouts.grade_against(rollouts.replicate(rollouts.spread(texts, "example_id"), 2), examples)
    assert "Broadcast" not in physical(graded)
    got = sorted((r.example_id, r.final_text, r.draw_id, r.label) for r in graded.collect())
    assert got == [(e, t, d, x) for e, t, x in ((1, "5", 0.0), (1, "so 4", 1.0), (2, "#### 7.0", 1.0)) for d in (0, 1)]


def test_velocity_of_odd_vectors_in_either_window(spark):
    rows = [(1, 0, 0, [1.0, 2.0]), (1, 0, 1, [1.5, None]), (1, 0, 2, [1.0]), (1, 0, 3, None), (1, 0, 4, [2.0, 0.0]), (2, 0, 0, [3.0, 4.0]), (2, 0, 1, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "example_id int, rollout_id int, step_id int, latent array<double>")
    want = [([-5.0, None], None), ([5.0, None], None), (None, None), (None, None), (None, None), ([30.0, 40.0], 50.0), (None, None)]
    for chunk in (None, 2):
        got = latents.step_velocity(df, 10, chunk=chunk).orderBy("example_id", "step_id").collect()
        assert [(r.velocity, r.velocity_norm) for r in got] == want


def test_trajectories_are_sorted_before_they_get_their_latent(spark):
    sf_dir = "/root/testdata/sf0.001"
    from tracemill.plans import rollout_queries

    for query in (rollout_queries.step_velocity, rollout_queries.median_bandwidth, rollout_queries.repulsion, rollout_queries.mean_reward_by_step):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
        try:
            plan = physical(query(spark, sf_dir)).splitlines()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        wide = [i for i, line in enumerate(plan) if "BroadcastHashJoin [vec_id" in line][0]  # the first in the plan: all above is wide
        assert not any("Sort [" in line or "hashpartitioning(vec_id" in line for line in plan[:wide])


def test_scorer_batches_move_no_latent(spark):
    import __spark_entry__ as entry

    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical(entry.queries()["scorer_batches"](spark, "/root/testdata/sf0.001")).split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    dealt = [below for node, below in zip(plan, plan[1:]) if " Exchange " in node and "REPARTITION_BY_NUM" not in node]
    assert dealt and not [x for x in dealt if "latent#" in x and "partial_" not in x]
    sorts = [below for node, below in zip(plan, plan[1:]) if "Sort [" in node and "latent#" in below]
    assert len(sorts) <= 1  # where the pointers lie; the plan's pairs need none


def test_questions_become_ids_before_states_multiply_them(spark):
    from tracemill.operators import scorer

    asked = spark.createDataFrame([(1, None, "a b c d"), (2, "x y", "z"), (3, None, None)], "e int, input string, question string")
    split = lambda q: F.transform(F.split(q, " "), lambda w: F.length(w))
    states = spark.createDataFrame([(e, "s", i, None, 1) for i, e in enumerate((1, 1, 2, 3))], "e int, shard string, row int, timestep int, label int")
    stored = spark.createDataFrame([("s", i, [float(i)]) for i in range(4)], "shard string, row int, latent array<double>")
    late = scorer.scorer_rows(states.join(asked, "e"), stored, split, max_tokens=3)
    early = scorer.scorer_rows(states.join(scorer.question_ids(asked, split, max_tokens=3), "e"), stored)
    columns = ["e", "row", "input_ids", "timestep", "label", "latent"]
    want = [(1, 0, [1, 1, 1]), (1, 1, [1, 1, 1]), (2, 2, [1, 1]), (3, 3, [0])]
    for got in (late, early):
        assert sorted(map(tuple, got.select(columns).collect())) == [(e, i, ids, 0.0, 1.0, [float(i)]) for e, i, ids in want]
    with pytest.raises(ValueError, match="input_ids"):
        scorer.scorer_rows(states, stored)
    rows = [(e, i, batch.batch_id, batch.batch_row, batch.input_ids) for batch in scorer.scorer_batches(early, ["shard", "row"], natural_order(early, "row"), 2).collect() for e, i in [(batch.e, batch.row)]]
    assert sorted(rows) == [(1, 0, 0, 0, [1, 1, 1]), (1, 1, 0, 1, [1, 1, 1]), (2, 2, 1, 0, [1, 1]), (3, 3, 1, 1, [0, 0])]


def test_scorer_batches_are_numbered_where_the_shards_lie(spark):
    import __spark_entry__ as entry

    plan = physical(entry.queries()["scorer_batches"](spark, "/root/testdata/sf0.001"))
    assert "rangepartitioning" not in plan  # nothing is sampled, ranged and sent back
    assert "SortMergeJoin [shard" in plan and "Sort [shard" not in plan  # sorted once, when they were dealt
    states = [line for line in plan.split("\n") if "Generate explode" in line and "sequence(0, 7" in line]
    assert not states  # states are not joined with their places: an example brings its rank along


@pytest.mark.parametrize("batch_rows", [1, 3, 7, 100])
@pytest.mark.parametrize("dealt", [True, False])
def test_batches_of_runs_equal_batches_of_sorted_rows(spark, batch_rows, dealt):
    from tracemill.operators import batches
    from tracemill.operators.numbering import run_order

    # Runs 2, 9 and 10 of other lengths, gaps in the rows, and ids that come twice.
    ids = [("s2", r) for r in (0, 1, 5)] + [("s9", 3)] + [("s10", r) for r in range(11)] + [("s10", 4), ("s2", 5)]
    rows = [(s, r, list(range(1 + r % 4)), f"{s}:{r}") for s, r in ids]
    df = spark.createDataFrame(rows, "shard string, row int, ids array<int>, more string")
    if dealt:
        df = df.repartition(3, "shard").sortWithinPartitions("shard", "row")
    number = F.regexp_extract("shard", r"(\d+)$", 1).cast("int")
    natural = batches.pad_batches(df, ["shard", "row"], natural_order(df, number * 100 + F.col("row")), {"ids": -1}, batch_rows, 2)
    order = run_order("shard", "row", lambda shard: F.regexp_extract(shard, r"(\d+)$", 1).cast("int"))
    runs = batches.pad_batches(df, ["shard", "row"], order, {"ids": -1}, batch_rows, 2)
    assert sorted(runs.columns) == sorted(natural.columns)
    want, got = ([tuple(map(str, r)) for r in x.select(sorted(x.columns)).collect()] for x in (natural, runs))
    assert sorted(got) == sorted(want) and len(got) == 13 + 2 * 4
    with pytest.raises(ValueError, match="run and the row"):
        batches.pad_batches(df, "row", order, {"ids": 0}, 2)


def test_what_was_sorted_when_dealt_is_not_sorted_again(spark):
    from tracemill.sources import staged

    df = spark.range(500).selectExpr("cast(id % 7 as string) as shard", "cast(499 - id as int) as row")
    left, right = (staged.stage_dealt(df, name, "shard", ("shard", "row")) for name in ("one", "two"))
    joined = left.join(right.hint("merge"), ["shard", "row"])
    assert "Sort [" not in physical(joined) and "Exchange" not in physical(joined)
    assert joined.count() == 500
