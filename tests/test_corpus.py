import pytest
from pyspark.sql import functions as F

from tracemill.operators import corpus


def test_split_answer(spark):
    rows = [
        ("a\n b \n\n#### 7", ["a", "b"], "7"),
        ("a", ["a"], ""),
        ("a #### b #### 3", ["a #### b"], "3"),
        ("a#####", ["a#"], ""),
        ("é ü #### ñ", ["é", "ü"], "ñ"),
        ("", [], ""),
        ("####", [], ""),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, answer string")
    got = corpus.split_answer(df).orderBy("i").collect()
    assert [(r.steps, r.answer) for r in got] == [(s, f) for _, s, f in rows]


def test_complexity(spark):
    df = spark.createDataFrame([(["<<1+1=2>> a", "<<2*3=6>>"],), ([],), (None,)], "steps array<string>")
    got = [tuple(r)[1:] for r in corpus.with_complexity(df).collect()]
    assert got == [(2, 2, 3), (0, 0, 0), (0, 0, 0)]


def test_canonical_stepwise(spark):
    df = spark.createDataFrame(
        [(" q ", [" a ", " ", "b"], " 3 "), ("q", None, None), ("q", ["x"], "")],
        "question string, steps array<string>, answer string",
    )
    got = [(r.input, r.output, r.answer, r.solutions) for r in corpus.canonical_stepwise(df).collect()]
    assert got == [("q", "a\nb\n#### 3", "3", ["3"]), ("q", "", "", []), ("q", "x", "", [])]


def test_missing_question_is_an_error(spark):
    df = spark.createDataFrame([(None, ["x"], "1")], "question string, steps array<string>, answer string")
    with pytest.raises(Exception, match="record without question"):
        corpus.canonical_stepwise(df).collect()


def test_first_target_and_fallbacks(spark):
    df = spark.createDataFrame(
        [(["s"], "a", "o"), ([], "a", "o"), (None, "", "o"), (None, None, None)],
        "solutions array<string>, answer string, output string",
    )
    got = [r.t for r in df.select(corpus.first_target().alias("t")).collect()]
    assert got == [["s"], ["a"], ["o"], None]
    texts = spark.createDataFrame(
        [("r", "q", "o"), ("", "q", "o"), (None, "q", None)], "reasoning_text string, input string, output string"
    )
    assert [r.t for r in texts.select(corpus.text_or_built().alias("t")).collect()] == ["r", "q\no", "q\n"]


def test_prompts_and_variants(spark):
    df = spark.createDataFrame([("q", "o", ["s"])], "input string, output string, solutions array<string>")
    train = corpus.prompt_columns(df, train=True).first()
    assert (train.input_prompt, train.reasoning_text, train.gt_solutions) == ("q\n", "q\no", None)
    assert corpus.prompt_columns(df, train=False).first().gt_solutions == ["s"]
    with pytest.raises(ValueError):
        corpus.input_variant(corpus.vae_view(df), "q_q_only")
    assert corpus.drop_blank(df.withColumn("x", F.lit(" \t")), "x").count() == 0
