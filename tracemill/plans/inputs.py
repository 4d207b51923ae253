"""Inputs derived from the given tables: the texts there hold no graded answers, so answers,
rollouts and trajectories are computed row by row from orders and embeddings. `oracle.py`
states the same derivations in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import uniform, words
from ..functions.tokens import hashed_token_ids
from ..operators.corpus import drop_blank
from ..operators.joins import is_small, lookup_join, small_side, sorted_before
from ..operators.rollouts import cross_rollouts, replicate, spread
from ..sources.readers import read_table

# Unique keys of the tables whose rows are expensive to process.
KEYS = {"orders": "o_orderkey", "documents": "doc_id", "embeddings": "vec_id"}
ROLLOUTS = 8
STEPS = 5
STATES = STEPS + 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet", KEYS.get(name))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, n, question, answer: one arithmetic problem per order, 1 to 9 solution lines."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderstatus").alias("status"),
        F.floor("o_totalprice").cast("long").alias("c"),
        (1 + F.col("o_orderkey") % 9).alias("k"),
    )
    line = lambda i: F.concat(
        F.when(i % 4 == 0, F.lit("  \n")).otherwise(F.lit("")),
        _text("  Line ", i, ": <<", F.col("c"), "*", i, "=", F.col("c") * i, ">> items "),
    )
    body = F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), F.col("k")), line), "\n")
    n = F.col("c") * F.col("k")
    shown = F.when(F.col("id") % 5 == 0, F.format_number(n, 0)).otherwise(n.cast("string"))
    ending = (
        F.when(F.col("id") % 11 == 0, F.lit(""))
        .when(F.col("id") % 13 == 0, _text(" #### 0\nCheck\n#### ", shown))
        .when(F.col("id") % 17 == 0, _text("\n##### ", shown))
        .otherwise(_text("\n#### ", shown, " "))
    )
    question = _text("  How many items has order ", F.col("id"), " in status ", F.col("status"), "?\n")
    return orders.select("id", n.alias("n"), question.alias("question"), F.concat(body, ending).alias("answer"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """example_id, rollout_id, question, target, final_text: eight decoded answers per problem, in
    seven phrasings, right about six times in ten."""
    problems = qa(spark, sf_dir).select(F.col("id").alias("example_id"), "question", "n")
    drawn = replicate(spread(problems, "example_id"), ROLLOUTS, "rollout_id")
    right = uniform("r", "example_id", "rollout_id") < 0.6
    v = F.when(right, F.col("n")).otherwise(F.col("n") + 1)
    form = (F.col("example_id") + F.col("rollout_id")) % 7
    text = (
        F.when(form == 0, _text("Thus $\\boxed{", v, "}$."))
        .when(form == 1, _text("So \\boxed{\\frac{", v * 2, "}{2}}"))
        .when(form == 2, _text("Adding up\n#### ", v))
        .when(form == 3, _text("The answer is: $", v, "$.\nDone"))
        .when(form == 4, _text("total\\, = ", v))
        .when(form == 5, _text("I get ", F.format_number(v, 0), " items\n"))
        .otherwise(F.lit("no idea"))
    )
    return drawn.select(
        "example_id",
        "rollout_id",
        "question",
        F.array(F.lit(None).cast("string"), F.col("n").cast("string")).alias("target"),
        text.alias("final_text"),
    )


def vector_count(spark: SparkSession, sf_dir: str) -> Column:
    return table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1))).scalar()


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """example_id: every order."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("example_id"))


def states(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """example_id, rollout_id, step_id, timestep, reward, vec_id: one narrow row per logged state, with the vector it
    points to. The rows of an example lie in one partition. `of` are the examples, whose other columns all their
    states carry; otherwise every order."""
    grid = cross_rollouts(examples(spark, sf_dir) if of is None else of, ROLLOUTS, STEPS)
    pointer = (F.col("example_id") * 31 + F.col("rollout_id") * 7 + F.col("step_id")) % vector_count(spark, sf_dir)
    return grid.select(
        "*",
        (uniform("s", "example_id", "rollout_id", "step_id") < 0.5).cast("double").alias("reward"),
        pointer.alias("vec_id"),
    )


def with_latents(spark: SparkSession, sf_dir: str, pointed: DataFrame, derived: dict[str, Column] | None = None) -> DataFrame:
    """Rows with the vector that their vec_id points to as `latent`, in place of vec_id. Rows that were dealt out and
    sorted before this stay so wherever the vectors can be sent to every machine: wide rows are not moved.
    `derived` names further columns of the latent, which are computed once per vector."""
    return lookup_join(pointed, small_side(vectors(spark, sf_dir).withColumns(derived or {})), "vec_id").drop("vec_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, latent: what the states point to."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("latent"))


def vectors_are_sent(spark: SparkSession, sf_dir: str) -> bool:
    """Whether `with_latents` sends the vectors to every machine, so that rows stay where they are."""
    return is_small(vectors(spark, sf_dir))


def trajectories(
    spark: SparkSession, sf_dir: str, order: tuple[str, ...] = (), derived: dict[str, Column] | None = None
) -> DataFrame:
    """example_id, rollout_id, step_id, timestep, reward, latent: one row per logged state. The rows of an example
    lie in one partition; with `order`, partitions are sorted by these columns before states get their latent.
    `derived` as in `with_latents`."""
    pointed = states(spark, sf_dir)
    if order:
        pointed = sorted_before(pointed, *order)
    return with_latents(spark, sf_dir, pointed, derived)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text_id, text: every whole text of the tables and every response."""
    parts = [
        responses(spark, sf_dir).select(
            _text("r:", F.col("example_id"), ":", F.col("rollout_id")).alias("text_id"), F.col("final_text").alias("text")
        ),
        table(spark, sf_dir, "documents").select(_text("d:", F.col("doc_id")).alias("text_id"), "text"),
        table(spark, sf_dir, "pages").select(_text("p:", F.col("page_id")).alias("text_id"), F.col("html").alias("text")),
        table(spark, sf_dir, "benchmark").select(_text("b:", F.col("item_id")).alias("text_id"), "text"),
        table(spark, sf_dir, "conversations").select(
            _text("c:", F.col("conv_id"), ":", F.col("turn")).alias("text_id"), "text"
        ),
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, input, output: each user turn with the assistant turn after it."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("input"))
    answered = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output")
    )
    return asked.join(answered, ["conv_id", "turn"])


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids: whitespace tokens of whole documents as hashed ids."""
    filled = drop_blank(table(spark, sf_dir, "documents"), "text")
    return filled.select("doc_id", hashed_token_ids(words("text")).alias("ids"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, logit, label."""
    lengths = table(spark, sf_dir, "documents").select(
        "doc_id", ((F.col("n_chars") % 2001 - 1000) / 250.0).alias("logit")
    )
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    return lengths.join(labels, "doc_id")


def gaussians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, mu, log_var: the two halves of each embedding."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        "label",
        F.slice("embedding", 1, 32).cast("array<double>").alias("mu"),
        F.slice("embedding", 33, 32).cast("array<double>").alias("log_var"),
    )
