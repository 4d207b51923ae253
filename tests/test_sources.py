import json

import pytest
from pyspark.sql import functions as F

from tracemill.operators import rollouts, splits
from tracemill.plans import inputs
from tracemill.sources import readers, schemas, shards, writers
from tracemill.streaming import append_log

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(json.dumps(r.asDict(recursive=True), sort_keys=True) for r in df.collect())


@pytest.fixture(scope="module")
def canonical(spark):
    return inputs.qa(spark, SF).select(
        F.col("question").alias("input"),
        F.col("answer").alias("output"),
        F.when(F.col("id") % 3 > 0, F.col("n").cast("string")).alias("answer"),
        F.array(F.col("n").cast("string")).alias("solutions"),
    )


def test_jsonl_round_trip(spark, canonical, tmp_path):
    path = str(tmp_path / "deep" / "out")
    assert writers.write_jsonl(canonical, path) == canonical.count()
    assert writers.write_jsonl(canonical, path) == canonical.count()
    assert _rows(readers.read_jsonl(spark, path, schemas.CANONICAL)) == _rows(canonical)


def test_jsonl_blank_and_bad_lines(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"input":"é","output":"b"}\n\n  \n{"input":"c","output":"d"}\n')
    bad.write_text('{"input":"a","output":"b"}\n{"input":\n')
    assert readers.read_jsonl(spark, str(good), schemas.MINIMAL).count() == 2
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(bad), schemas.MINIMAL).collect()


def test_json_array(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    records = [{"question": "q", "steps": ["a", "b"], "answer": "1"}, {"question": "r", "steps": [], "answer": "2"}]
    good.write_text("\n " + json.dumps(records, indent=2))
    bad.write_text(json.dumps(records[0]))
    assert sorted(map(tuple, readers.read_json_array(spark, str(good), schemas.STEPWISE).collect())) == [
        ("q", ["a", "b"], "1"),
        ("r", [], "2"),
    ]
    with pytest.raises(ValueError, match="JSON list"):
        readers.read_json_array(spark, str(bad), schemas.STEPWISE)


@pytest.mark.parametrize("split_bytes", ["128m", "4k"])
def test_line_numbers(spark, tmp_path, split_bytes):
    folder = tmp_path / split_bytes
    folder.mkdir()
    for name, count in (("a", 3000), ("b", 40), ("c", 700)):
        lines = ["" if i % 7 == 3 else json.dumps({"input": f"{name}{i}", "output": "x" * (i % 50)}) for i in range(count)]
        (folder / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        one = readers.read_examples(spark, str(folder / "a.jsonl"), schemas.MINIMAL)
        assert one.filter(F.concat(F.lit("a"), F.col("example_id").cast("string")) != F.col("input")).count() == 0
        assert one.count() == sum(i % 7 != 3 for i in range(3000))
        some = readers.read_examples(spark, str(folder / "a.jsonl"), schemas.MINIMAL, max_lines=10)
        assert sorted(r.example_id for r in some.collect()) == [0, 1, 2, 4, 5, 6, 7, 8, 9]
        every = readers.read_numbered_lines(spark, str(folder))
        assert every.count() == 3740 and every.select("file", "line_id").distinct().count() == 3740
        shown = F.regexp_extract("value", r'"input": "[a-c](\d+)"', 1)
        assert every.filter((F.col("value") != "") & (shown.try_cast("long") != F.col("line_id"))).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_split_outputs_and_aliases(spark, tmp_path):
    docs = inputs.table(spark, SF, "documents").select("doc_id", "text")
    labelled = splits.three_way_split(docs, "doc_id", 30, 20)
    out = writers.write_splits(labelled, str(tmp_path / "s"), ["train", "val", "test"], writers.RESPONSE_ALIASES)
    assert {k: n for k, (_, n) in out.items()} == {
        "train": 150, "val": 30, "test": 20, "hard": 20, "vae_train": 150, "vae_val": 30
    }
    schema = docs.schema
    for path, n in out.values():
        assert readers.read_jsonl(spark, path, schema).count() == n
    assert _rows(readers.read_jsonl(spark, str(tmp_path / "s"), schema).select("doc_id", "text")) == _rows(docs)


def test_refuse_overwrite_and_append(spark, canonical, tmp_path):
    path = str(tmp_path / "t")
    n = writers.write_table(canonical, path, overwrite=False)
    with pytest.raises(Exception, match="already exists"):
        writers.write_table(canonical, path, overwrite=False)
    assert writers.append_records(canonical, path, "parquet") == n
    assert readers.read_landed_split(spark, path).count() == 2 * n


def test_shards_round_trip(spark, tmp_path):
    log = inputs.trajectories(spark, SF)
    examples = rollouts.with_example_rank(log.select("example_id").distinct())
    facts = rollouts.assign_shards(log.join(examples, "example_id"), inputs.ROLLOUTS, inputs.STATES)
    path = str(tmp_path / "shards")
    assert writers.write_shards(facts, path) == facts.count()
    metadata, latents = readers.read_shards(spark, path)
    back = rollouts.resolve_latents(metadata.drop("shard_group"), latents.drop("shard_group"))
    columns = ["example_id", "rollout_id", "step_id", "latent"]
    assert back.select(columns).exceptAll(log.select(columns)).count() == 0
    assert back.count() == log.count()
    with pytest.raises(Exception, match="already exists"):
        writers.write_shards(facts, path)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hashed", [0, 1_000_000])
def test_pointer_join_reads_shards_where_they_lie(spark, tmp_path, monkeypatch, hashed):
    facts = spark.range(3000).selectExpr(
        "id div 100 as shard_id", "format_string('latents-%06d', id div 100) as shard", "cast(id % 100 as int) as row",
        "id as example_id", "array(cast(id as float), cast(-id as float)) as latent",
    )
    path = str(tmp_path / "shards")
    assert writers.write_shards(facts.repartition(7), path, buckets=6, shards_per_group=5) == 3000
    files = list((tmp_path / "shards" / "latents").glob("shard_group=*/*.parquet"))
    assert len(list((tmp_path / "shards" / "latents").glob("shard_group=*"))) == 6 and len(files) <= 36
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(shards, "HASHED_ROWS", hashed)
    try:
        metadata, latents = readers.read_shards(spark, path)
        joined = rollouts.resolve_latents(metadata.filter("example_id between 700 and 1290"), latents)
        got = {r.example_id: (r.shard_group, r.shard, r.row, list(r.latent)) for r in joined.collect()}
        plan = _plan(joined)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    assert got == {i: (i // 500, f"latents-{i // 100:06d}", i % 100, [i, -i]) for i in range(700, 1291)}
    assert ("ShuffledHashJoin" if hashed else "SortMergeJoin") in plan
    # No row of either scan is exchanged, only the list of directories is gathered and sent.
    dealt = {line.split("hashpartitioning")[1].split(", ENSURE")[0] for line in plan.split("\n") if "hashpartitioning" in line}
    assert all(x.startswith("(shard_group#") and "shard#" not in x for x in dealt)
    assert "dynamicpruning" in plan
    read = joined.select("shard_group").distinct().collect()
    assert sorted(r.shard_group for r in read) == [1, 2]
    shards.detach_shards(spark, path)
    assert not [t for t in spark.catalog.listTables() if shards._table_name(path, "latents") == t.name]
    with pytest.raises(FileNotFoundError):
        readers.read_shards(spark, str(tmp_path / "nothing"))


def test_shards_take_latents_where_they_lie(spark, tmp_path, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i), -1.0]) for i in range(3)], "vec_id int, latent array<double>")
    facts = spark.range(40).selectExpr("id div 10 as shard_id", "'s' || (id div 10) as shard", "cast(id % 10 as int) as row", "cast(id % 4 as int) as vec_id", "id")
    path, plans, store = str(tmp_path / "shards"), [], shards._store
    monkeypatch.setattr(shards, "_store", lambda df, *rest: plans.append(_plan(df)) or store(df, *rest))
    attach = lambda dealt: dealt.join(F.broadcast(vectors), "vec_id").drop("vec_id")
    assert writers.write_shards(facts, path, buckets=3, widen=attach) == 30
    assert plans[0].index("BroadcastHashJoin") < plans[0].index("Exchange hashpartitioning(shard")
    metadata, latents = readers.read_shards(spark, path)
    back = rollouts.resolve_latents(metadata, latents)
    assert sorted((r.id, r.shard, r.row, r.latent[0]) for r in back.collect()) == [(i, f"s{i // 10}", i % 10, i % 4) for i in range(40) if i % 4 < 3]
    shards.detach_shards(spark, path)


@pytest.mark.parametrize("hashed", [0, 1_000_000])
def test_shards_store_a_vector_once_that_many_states_point_to(spark, tmp_path, monkeypatch, hashed):
    monkeypatch.setattr(shards, "HASHED_ROWS", hashed)
    # One vector is null, one comes twice, and some pointers lead nowhere.
    rows = [(0, [0.5, 1.0]), (1, None), (2, [2.0, 3.0]), (2, [4.0, 5.0]), (3, [6.0])]
    vectors = spark.createDataFrame(rows, "vec_id int, latent array<float>")
    facts = spark.range(400).selectExpr("id div 10 as shard_id", "'s' || (id div 10) as shard", "cast(id % 10 as int) as row", "cast(id % 5 as int) as vec_id", "id")
    found = []
    for path, more in ((str(tmp_path / "whole"), {}), (str(tmp_path / "pointed"), {"vectors": vectors})):
        given = facts if more else facts.join(vectors, "vec_id").drop("vec_id")
        assert writers.write_shards(given, path, buckets=3, shards_per_group=7, **more) == 400
        metadata, latents = readers.read_shards(spark, path)
        joined = rollouts.resolve_latents(metadata, latents)
        found.append([sorted(map(repr, df.select(sorted(df.columns)).collect())) for df in (metadata, latents, joined)])
        shards.detach_shards(spark, path)
    assert found[0] == found[1] and len(found[0][2]) == 80 * 3 + 80 * 4
    assert "latent" not in spark.read.parquet(f"{tmp_path}/pointed/latents").columns
    assert spark.read.parquet(f"{tmp_path}/pointed/vectors").count() == len(rows)


def test_pointer_join_stores_no_latent_per_state(spark):
    from tracemill.plans import rollout_queries

    path = rollout_queries._shard_folder(spark, SF)
    assert "latent" not in spark.read.parquet(f"{path}/latents").columns
    assert spark.read.parquet(f"{path}/latents").count() == 1500 * 48


def test_rollout_files_with_mixed_fields(spark, tmp_path):
    meta, log = tmp_path / "m.jsonl", tmp_path / "l.jsonl"
    base = {"example_id": 1, "rollout_id": 0, "step_id": 0, "input": "q", "timestep": 999.0, "label": 1.0,
            "final_text": "t", "shard": "latents-000000", "row": 0}
    meta.write_text("\n".join(json.dumps({**base, "target": t}) for t in (["4", "5"], "x")))
    assert [r.target for r in readers.read_rollout_metadata(spark, str(meta)).collect()] == [["4", "5"], ["x"]]
    entry = {"input": "q", "solution": "s", "text": "t", "reward": 1.0, "lst_reward": 1.0, "tokens": [[[1.0, 2.0], [3.0, 4.0]]]}
    log.write_text("\n".join(json.dumps({**entry, "infer_steps": s}) for s in ("gt", 979.0)))
    got = readers.read_rollout_log(spark, str(log)).collect()
    assert [(r.is_gt, r.timestep) for r in got] == [(True, None), (False, 979.0)]
    assert got[0].tokens == [[1.0, 2.0], [3.0, 4.0]]


def test_evaluation_sink(spark, tmp_path):
    pairs = spark.createDataFrame([(1, "a", "b")], "line_id int, input string, output string")
    assert writers.write_evaluation(pairs, str(tmp_path / "e")) == 1
    assert readers.read_jsonl(spark, str(tmp_path / "e"), schemas.MINIMAL).first().asDict() == {"input": "a", "output": "b"}


def test_streamed_grading(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    examples = spark.createDataFrame([(1, ["4"]), (2, ["5"])], "example_id int, target array<string>")

    def land(name, rows):
        (source / name).write_text("\n".join(json.dumps({"example_id": e, "final_text": t}) for e, t in rows))

    def run():
        stream = append_log.stream_jsonl(spark, str(source), spark.createDataFrame([], "example_id int, final_text string").schema)
        append_log.append_graded(stream, examples, out, str(tmp_path / "ck"), once=True).awaitTermination(120)

    land("a.json", [(1, "answer is 4"), (2, "answer is 4")])
    run()
    land("b.json", [(2, r"\boxed{5}")])
    run()
    got = sorted((r.example_id, r.final_text, r.label) for r in spark.read.parquet(out).collect())
    assert got == [(1, "answer is 4", 1.0), (2, "\\boxed{5}", 1.0), (2, "answer is 4", 0.0)]


ARRAY = "a string, n int, deep struct<x: array<struct<y: string>>>"


@pytest.mark.parametrize("size", ["331b", "1m"])
def test_json_arrays_across_splits(spark, tmp_path, size):
    texts = ['plain', 'b{r}a[c]e}s', 'quo\\"te', 'back\\\\', '\\\\"}{', 'é😀}', '', ',[', 'line\nbreak"', '}}}}', None]
    records = [{"a": t, "n": i, "deep": {"x": [{"y": u}, {"y": "]"}]}} for i, (t, u) in enumerate(zip(texts, reversed(texts)))]
    folder = tmp_path / "arrays"
    folder.mkdir()
    (folder / "one.json").write_text(json.dumps(records))
    (folder / "two.json").write_text("\n " + json.dumps(records, indent=2, ensure_ascii=False) + " \n")
    (folder / "three.json").write_text(" [ ] ")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = readers.read_json_array(spark, str(folder), ARRAY).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    found = sorted(json.dumps(r.asDict(recursive=True), sort_keys=True) for r in got)
    assert found == sorted(json.dumps(r, sort_keys=True) for r in records * 2)


@pytest.mark.parametrize("text", ['{"a": "x"}', '[{"a": "x"}', '[{"a": "x"}, 3]', '[{"a": "x"} {"a": "y"}]'])
def test_files_that_hold_no_json_list_of_objects(spark, tmp_path, text):
    path = tmp_path / "f.json"
    path.write_text(text)
    if text:
        with pytest.raises(Exception, match="JSON list"):
            readers.read_json_array(spark, str(path), ARRAY).collect()
