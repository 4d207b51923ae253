"""Operators over tables of latent vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import constants as K
from ..functions import vectors as V
from .rollouts import replicate


def noised_pairs(
    latents: DataFrame,
    key: str,
    vector: str,
    seed: int = 42,
    draws: int = K.NOISE_DRAWS,
    prediction: str = "flow",
) -> DataFrame:
    """`draws` training pairs per latent: timestep, noised vector and regression target."""
    drawn = replicate(latents, draws).withColumn("__noise", V.noise_like(vector, f"noise-{seed}", key, "draw_id"))
    return drawn.select(
        *latents.columns,
        "draw_id",
        V.random_timestep(f"timestep-{seed}", key, "draw_id").alias("timestep"),
        V.add_noise(vector, "__noise").alias("noised"),
        V.training_target(vector, "__noise", prediction).alias("regression_target"),
    )


def step_velocity(
    log: DataFrame,
    steps: int,
    rollout_key: tuple[str, ...] = ("example_id", "rollout_id"),
    step: str = "step_id",
    latent: str = "latent",
    chunk: int | None = 64,
) -> DataFrame:
    """Append velocity (state minus next state, over the sigma gap 1/steps) and its norm; null for
    the last state.

    Rollouts are windowed in chunks of steps. The first state of a chunk is also sent to the chunk
    before it, so that a rollout of any length spreads over tasks. Without chunks (for rollouts of few steps)
    nothing is copied, and rows that lie sorted by rollout and step are not sorted again.
    """
    if chunk is None:
        whole = F.lead(latent).over(Window.partitionBy(*rollout_key).orderBy(step))
        return _velocity(log.filter(F.col(step).isNotNull()).withColumn("__next", whole), steps, latent).drop("__next")
    home = F.floor(F.col(step) / chunk)
    is_border = (F.col(step) % chunk == 0) & (F.col(step) > 0)
    copies = log.withColumn("__home", home).withColumn(
        "__chunk",
        F.explode(
            F.when(is_border, F.array(F.col("__home"), F.col("__home") - 1)).otherwise(F.array(F.col("__home")))
        ),
    )
    following = F.lead(latent).over(Window.partitionBy(*rollout_key, "__chunk").orderBy(step))
    paired = copies.withColumn("__next", following).filter("__home = __chunk")
    return _velocity(paired, steps, latent).drop("__home", "__chunk", "__next")


def _velocity(paired: DataFrame, steps: int, latent: str) -> DataFrame:
    velocity = F.zip_with(
        latent, "__next", lambda x, y: (x.cast("double") - y.cast("double")) * F.lit(float(steps))
    )
    moved = paired.withColumn("velocity", F.when(F.col("__next").isNotNull(), velocity))
    return moved.withColumn("velocity_norm", V.l2_norm("velocity"))


def overall_mse(pairs: DataFrame, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean squared error over all elements of all rows (or per group)."""
    sums = pairs.select(*by, V.squared_error(a, b).alias("sse"), F.size(a).alias("n"))
    return sums.groupBy(*by).agg((F.sum("sse") / F.sum("n")).alias("mse"))


def mean_kl(segments: DataFrame, mu: str, log_var: str, by: tuple[str, ...]) -> DataFrame:
    """KL statistic per segment, averaged over the segments of a group."""
    return segments.select(*by, V.kl_to_standard_normal(mu, log_var).alias("kl")).groupBy(*by).agg(
        F.avg("kl").alias("kl")
    )


def latent_statistics(latents: DataFrame, vector: str, by: tuple[str, ...] = (), around: float = 0.0) -> DataFrame:
    """Shift (mean) and scale (1 / unbiased std) over all elements, from per-row moments rather than
    exploded elements. `around` is a guess of the mean that keeps the sums small when it is far from 0."""
    values = F.transform(V.doubles(vector), lambda x: x - around)
    moments = latents.select(*by, values.alias("v")).select(
        *by,
        F.size("v").alias("n"),
        V.total("v").alias("s"),
        F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x).alias("q"),
    )
    sums = moments.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    variance = F.try_divide(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.col("n") - 1)
    return sums.select(
        *by,
        F.col("n").alias("elements"),
        (F.col("s") / F.col("n") + around).alias("shift_factor"),
        F.try_divide(F.lit(1.0), F.sqrt(F.greatest(variance, F.lit(0.0)))).alias("scale_factor"),
    )
