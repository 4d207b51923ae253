"""From raw question/answer records to canonical reasoning examples. All projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K
from ..functions.answers import extract_answer
from ..functions.text import (
    after_last,
    as_column,
    before_last,
    empty_to_null,
    find_all,
    is_blank,
    lines,
    strip,
    words,
)

_NO_TEXTS = "array<string>"


def _no_texts() -> Column:
    return F.array().cast(_NO_TEXTS)


def answer_steps(text) -> Column:
    """Stripped non-empty lines before the last answer marker (all lines if there is none)."""
    text = as_column(text)
    reasoning = F.when(
        F.contains(text, F.lit(K.FINAL_MARKER)), before_last(text, K.FINAL_MARKER)
    ).otherwise(text)
    return F.filter(F.transform(lines(strip(reasoning)), strip), lambda line: line != "")


def answer_final(text) -> Column:
    """Stripped text after the last answer marker, '' if there is none."""
    text = as_column(text)
    return F.when(
        F.contains(text, F.lit(K.FINAL_MARKER)), strip(after_last(text, K.FINAL_MARKER))
    ).otherwise(F.lit(""))


def split_answer(df: DataFrame, source: str = "answer", steps: str = "steps", final: str = "answer") -> DataFrame:
    """Replace raw answer text by its reasoning steps and its final answer."""
    parsed = {steps: answer_steps(source), final: answer_final(source)}
    kept = [c for c in df.columns if c not in parsed]
    return df.select(*kept, *[value.alias(name) for name, value in parsed.items()])


def reasoning_text(steps, answer) -> Column:
    """Steps and the marked answer, one per line."""
    cleaned = F.filter(F.transform(F.coalesce(as_column(steps), _no_texts()), strip), lambda s: s != "")
    answer = strip(F.coalesce(as_column(answer), F.lit("")))
    marked = F.when(answer != "", F.array(F.concat(F.lit(K.FINAL_MARKER + " "), answer))).otherwise(_no_texts())
    return F.array_join(F.concat(cleaned, marked), "\n")


def solutions(answer) -> Column:
    answer = as_column(answer)
    return F.when(answer != "", F.array(answer)).otherwise(_no_texts())


def _required(column: str) -> Column:
    return F.when(
        F.col(column).isNull(), F.raise_error(F.lit(f"record without {column}"))
    ).otherwise(strip(column))


def canonical_stepwise(df: DataFrame) -> DataFrame:
    """question, steps, answer -> input, output, answer, solutions (other columns stay)."""
    kept = [c for c in df.columns if c not in {"question", "steps", "answer"}]
    answer = strip(F.coalesce(F.col("answer"), F.lit("")))
    return df.select(
        *kept,
        _required("question").alias("input"),
        reasoning_text("steps", "answer").alias("output"),
        answer.alias("answer"),
        solutions(answer).alias("solutions"),
    )


def canonical_response(df: DataFrame) -> DataFrame:
    """query, response -> input, output, answer, solutions, with the answer read from the response."""
    kept = [c for c in df.columns if c not in {"query", "response"}]
    stripped = df.select(*kept, _required("query").alias("input"), _required("response").alias("output"))
    answered = stripped.withColumn("answer", extract_answer("output"))
    return answered.withColumn("solutions", solutions("answer"))


def with_complexity(df: DataFrame, steps: str = "steps") -> DataFrame:
    """Append n_steps, n_marks (arithmetic annotations) and n_tokens."""
    joined = df.withColumn("__joined", F.array_join(F.coalesce(F.col(steps), _no_texts()), "\n"))
    return joined.select(
        *df.columns,
        F.size(F.coalesce(F.col(steps), _no_texts())).alias("n_steps"),
        F.size(find_all("__joined", K.ARITHMETIC_MARK, 0)).alias("n_marks"),
        F.size(words("__joined")).alias("n_tokens"),
    )


INPUT_VARIANTS = ("cot_only", "full_format")


def vae_view(df: DataFrame) -> DataFrame:
    """input, output -> question, chain_of_thought and both input variants."""
    kept = [c for c in df.columns if c not in {"input", "output"}]
    return df.select(
        *kept,
        F.col("input").alias("question"),
        F.col("output").alias("chain_of_thought"),
        F.col("output").alias("cot_only"),
        F.concat("input", F.lit("\n"), "output").alias("full_format"),
    )


def input_variant(df: DataFrame, variant: str, output: str = "text") -> DataFrame:
    if variant not in INPUT_VARIANTS:
        raise ValueError(f"input variant must be one of {INPUT_VARIANTS}, got {variant!r}")
    return df.withColumn(output, F.col(variant))


def prompt_columns(df: DataFrame, train: bool) -> DataFrame:
    """Append the prompt, the full text, and the gold solutions (null while training)."""
    gold = F.lit(None).cast(_NO_TEXTS) if train else F.col("solutions")
    return df.withColumns(
        {
            "input_prompt": F.concat("input", F.lit("\n")),
            "reasoning_text": F.concat("input", F.lit("\n"), "output"),
            "gt_solutions": gold,
        }
    )


def first_target(solutions_col="solutions", answer_col="answer", output_col="output") -> Column:
    """First non-empty of solutions, answer, output, as an array of targets."""
    listed, answer = as_column(solutions_col), as_column(answer_col)
    return F.coalesce(
        F.when(F.size(listed) > 0, listed),
        F.when(answer != "", F.array(answer)),
        F.when(as_column(output_col).isNotNull(), F.array(as_column(output_col))),
    )


def text_or_built(text_col="reasoning_text", question_col="input", output_col="output") -> Column:
    """The prepared text if there is one, else question, newline, output."""
    built = F.concat(as_column(question_col), F.lit("\n"), F.coalesce(as_column(output_col), F.lit("")))
    return F.coalesce(empty_to_null(text_col), built)


def question_or_empty(input_col="input", question_col="question") -> Column:
    return F.coalesce(empty_to_null(input_col), empty_to_null(question_col), F.lit(""))


def drop_blank(df: DataFrame, column: str) -> DataFrame:
    return df.filter(~is_blank(column))
