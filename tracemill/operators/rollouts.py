"""The rollout log: example x rollout x step facts, grading, selection, shards.

Facts made here never need a shuffle to learn their label: it is computed once per
rollout and carried through the explode. For logs that arrive already exploded, values
are pre-aggregated per rollout before they meet the rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import constants as K
from ..functions.answers import gold_forms, matches_gold, normal_form
from ..functions.text import as_column, shard_name
from ..functions.vectors import trajectory_timesteps
from .joins import lookup_join
from .numbering import natural_order, with_position


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition narrow rows by unique keys before a fan-out. Scan splits are sized for the input,
    not for what the fan-out makes of it; and grouping the many rows by these keys (or by more) later
    needs no further shuffle. The partition count is explicit because runtime merging would go by the
    size before the fan-out; AQE neither merges nor splits such a shuffle, so the keys must be unique."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *keys)


def replicate(df: DataFrame, copies: int, output: str = "draw_id") -> DataFrame:
    """`copies` rows per row, numbered from 0."""
    return df.withColumn(output, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))


def cross_rollouts(examples: DataFrame, rollouts: int, steps: int, key: str = "example_id") -> DataFrame:
    """The empty fact grid: one row per example, rollout and logged state (steps + 1 states),
    with the state's timestep. Timestep 0 occurs twice, so step_id is the key."""
    return replicate(spread(examples, key), rollouts, "rollout_id").select(
        "*", F.posexplode(trajectory_timesteps(steps)).alias("step_id", "timestep")
    )


def number_states(rollouts: DataFrame, trajectory: str = "trajectory", latent: str = "latent") -> DataFrame:
    """One row per state of a logged trajectory array, numbered from 0."""
    kept = [c for c in rollouts.columns if c != trajectory]
    return rollouts.select(*kept, F.posexplode(trajectory).alias("step_id", latent))


def reward_value(match) -> Column:
    return F.coalesce(as_column(match), F.lit(False)).cast("double")


def with_gold(examples: DataFrame, targets: str = "target", output: str = "gold") -> DataFrame:
    """Normalize the targets of each example once."""
    return examples.withColumn(output, gold_forms(targets))


def grade(
    predictions: DataFrame,
    text: str = "final_text",
    gold: str = "gold",
    output: str = "label",
    atol: float = K.ANSWER_TOLERANCE,
) -> DataFrame:
    """Append 1.0 where the text's answer matches any gold form, else 0.0; drops the gold column."""
    return predictions.withColumn(output, reward_value(matches_gold(normal_form(text), gold, atol))).drop(gold)


def grade_against(
    predictions: DataFrame,
    examples: DataFrame,
    key: str = "example_id",
    targets: str = "target",
    text: str = "final_text",
    output: str = "label",
) -> DataFrame:
    """Grade every prediction against its example's targets, which are normalized once. Both sides are usually
    computed from few rows (predictions by a fan-out), so neither may be broadcast on an estimate."""
    gold = with_gold(examples.select(key, targets), targets).select(key, "gold")
    return grade(lookup_join(predictions, gold.hint("merge"), key), text, "gold", output)


def rollout_facts(rollouts: DataFrame, steps: int) -> DataFrame:
    """One row per logged state of graded rollouts (example_id, rollout_id, input, target, label,
    final_text), every state carrying the rollout's label."""
    states = F.posexplode(trajectory_timesteps(steps)).alias("step_id", "timestep")
    facts = rollouts.select("example_id", "rollout_id", "input", "target", "label", "final_text", states)
    return facts.select(
        "example_id",
        "rollout_id",
        "step_id",
        "input",
        "target",
        F.col("timestep").cast("double").alias("timestep"),
        "label",
        "final_text",
    )


def last_step_reward(
    log: DataFrame,
    rollout_key: tuple[str, ...] = ("example_id", "rollout_id"),
    step: str = "step_id",
    reward: str = "reward",
    output: str = "lst_reward",
) -> DataFrame:
    """Append the reward of the rollout's last state to all of its states. A window computes the log once,
    needs no shuffle where the rows already lie by rollout, and keeps rows whose key is null, as one
    rollout of their own."""
    return log.withColumn(output, F.max_by(reward, step).over(Window.partitionBy(*rollout_key)))


def best_of_n(
    scored: DataFrame, group: str = "example_id", order: str = "rollout_id", reward: str = "reward"
) -> DataFrame:
    """The rollout with the highest reward per group, first one on ties. The rank filter is pushed
    below the shuffle, so each task sends one row per group."""
    ranking = Window.partitionBy(group).orderBy(F.desc(reward), F.asc(order))
    return scored.withColumn("__rank", F.row_number().over(ranking)).filter("__rank = 1").drop("__rank")


def with_ground_truth(log: DataFrame, truth: DataFrame) -> DataFrame:
    """Log rows plus one ground-truth row per example (is_gt, no timestep, final reward 1)."""
    gold = truth.withColumns(
        {"is_gt": F.lit(True), "timestep": F.lit(None).cast("double"), "lst_reward": F.lit(1.0)}
    )
    return gold.unionByName(log.withColumn("is_gt", F.lit(False)), allowMissingColumns=True)


def mean_by_step(log: DataFrame, measures: list[str], step: str = "step_id") -> DataFrame:
    return log.groupBy(step).agg(*[F.avg(m).alias(f"mean_{m}") for m in measures])


# Shards ----------------------------------------------------------------------


def with_example_rank(examples: DataFrame, key: str = "example_id", output: str = "example_rank") -> DataFrame:
    """Dense rank of the example id. Runs on the example table, before rollouts multiply it."""
    return with_position(examples, natural_order(examples, key), output)


def _shard_columns(sequence: Column, shard_rows: int) -> dict[str, Column]:
    shard_id = F.floor(sequence / shard_rows).cast("long")
    return {
        "shard_id": shard_id,
        "shard": shard_name(shard_id),
        "row": (sequence % shard_rows).cast("int"),
    }


def assign_shards(
    facts: DataFrame,
    rollouts: int,
    states: int,
    shard_rows: int = K.SHARD_ROWS,
    rank: str = "example_rank",
) -> DataFrame:
    """Shard and row of every fact in (example, rollout, step) order, by arithmetic on the example
    rank: every example has `rollouts` x `states` facts, so nothing has to be sorted."""
    sequence = F.col(rank) * (rollouts * states) + F.col("rollout_id") * states + F.col("step_id")
    return facts.withColumns(_shard_columns(sequence, shard_rows))


def assign_shards_ragged(
    facts: DataFrame, rollouts: int, states: int, shard_rows: int = K.SHARD_ROWS
) -> DataFrame:
    """The same for logs with gaps: `rollouts` and `states` are upper bounds, rows are numbered densely."""
    key = F.col("example_id").cast("long") * (rollouts * states) + F.col("rollout_id") * states + F.col("step_id")
    numbered = with_position(facts, natural_order(facts, key), "__sequence")
    return numbered.withColumns(_shard_columns(F.col("__sequence"), shard_rows)).drop("__sequence")


def resolve_latents(metadata: DataFrame, latents: DataFrame) -> DataFrame:
    """Attach the latent each metadata row points to. Tables from `sources.shards` meet by bucket, without a
    shuffle, and the latents' directories are pruned to those the metadata rows name: the list of these
    is broadcast, one number per directory that the driver has listed anyway."""
    if "shard_group" not in metadata.columns or "shard_group" not in latents.columns:
        return metadata.join(latents, ["shard", "row"])
    named = metadata.select("shard_group").distinct()
    pruned = latents.join(F.broadcast(named), "shard_group", "left_semi")
    return metadata.join(pruned, ["shard_group", "shard", "row"])


def join_outputs(references: DataFrame, outputs: DataFrame, key: str = "line_id") -> DataFrame:
    """Pair references and generated outputs by an explicit line id, never by position."""
    return references.join(outputs, key)
