"""Queries over latent vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import vectors as V
from ..operators import latents
from . import inputs, oracle as O
from .registry import query

SHIFT, SCALE, SEED = 0.05, 1.7, 42


def _micro(vector) -> Column:
    return F.array_join(
        F.transform(vector, lambda x: F.round(x.cast("double") * 1e6).cast("long").cast("string")), ","
    )


def _micro_scalar(x: Column) -> Column:
    return F.round(x * 1e6).cast("long")


@query(
    f"""select vec_id, {O.micro(f'list_transform(embedding, lambda z: (z::double - {SHIFT}::double) * {SCALE}::double)')} as encoded,
      {O.micro(f'list_transform(embedding, lambda z: z::double / {SCALE}::double + {SHIFT}::double)')} as decoded,
      {O.micro(f'list_transform(embedding, lambda z: z::double * {SCALE}::double)')} as scaled from embeddings"""
)
def rescale(spark, sf_dir):
    """Every vector rescaled both ways and by scale alone."""
    return inputs.table(spark, sf_dir, "embeddings").select(
        "vec_id",
        _micro(V.rescale("embedding", SHIFT, SCALE)).alias("encoded"),
        _micro(V.rescale("embedding", SHIFT, SCALE, "decode")).alias("decoded"),
        _micro(V.rescale("embedding", 0.0, SCALE)).alias("scaled"),
    )


_NOISED_SQL = f"""drawn as (select vec_id, draw_id, embedding::double[] as x,
   list_transform(range(len(embedding)), lambda i: {O.normal(f'noise-{SEED}', ['vec_id', 'draw_id'], 'i')}) as e
   from embeddings, (select unnest(range(8)) as draw_id))
"""


@query(
    f"""with {_NOISED_SQL} select vec_id, draw_id, cast(floor({O.draw(f'timestep-{SEED}', 'vec_id', 'draw_id')} * 1000) as bigint) as timestep,
      {O.micro('list_transform(list_zip(x, e), lambda p: p[1] + p[2])')} as noised,
      {O.micro('list_transform(list_zip(x, e), lambda p: p[2] - p[1])')} as regression_target from drawn"""
)
def noised_pairs(spark, sf_dir):
    """Eight noised training pairs per vector."""
    vectors = inputs.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pairs = latents.noised_pairs(vectors, "vec_id", "embedding", SEED)
    return pairs.select(
        "vec_id",
        "draw_id",
        "timestep",
        _micro("noised").alias("noised"),
        _micro("regression_target").alias("regression_target"),
    )


@query(
    f"""with {_NOISED_SQL} select vec_id, {O.micro('e')} as epsilon, {O.micro('x')} as sample,
      {O.micro('list_transform(list_zip(x, e), lambda p: p[2] - p[1])')} as flow from drawn where draw_id = 0"""
)
def flow_target(spark, sf_dir):
    """The regression target under each prediction type, for one draw per vector."""
    vectors = inputs.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    drawn = vectors.withColumn("noise", V.noise_like("embedding", f"noise-{SEED}", "vec_id", F.lit(0)))
    kinds = ("epsilon", "sample", "flow")
    return drawn.select("vec_id", *[_micro(V.training_target("embedding", "noise", k)).alias(k) for k in kinds])


@query(f"select o_orderkey, cast(floor({O.draw('t', 'o_orderkey')} * 1000) as bigint) as timestep from orders")
def random_timestep(spark, sf_dir):
    """A random timestep per order."""
    return inputs.table(spark, sf_dir, "orders").select("o_orderkey", V.random_timestep("t", "o_orderkey").alias("timestep"))


@query(
    f"""with v as (select vec_id, list_transform(list_zip(embedding, range(len(embedding))), lambda p:
         case when (vec_id + p[2]) % 50 = 0 then 0.0::double else p[1]::double end) as x from embeddings),
    n as (select vec_id, x, greatest(sqrt(list_sum(list_transform(x, lambda a: a * a))), 1e-6) as norm from v)
    select vec_id, {O.micro_scalar('norm')} as norm, {O.micro('list_transform(x, lambda a: a * least(0.5::double / norm, 1.0::double))')} as clipped from n"""
)
def clip_norm(spark, sf_dir):
    """Vectors with some non-finite elements, cleaned and clipped to norm 0.5."""
    damaged = F.transform(
        "embedding",
        lambda x, i: F.when((F.col("vec_id") + i) % 100 == 0, F.lit(float("nan")))
        .when((F.col("vec_id") + i) % 50 == 0, F.lit(float("-inf")))
        .otherwise(x.cast("double")),
    )
    df = inputs.table(spark, sf_dir, "embeddings").select("vec_id", damaged.alias("x"))
    clipped = df.select("vec_id", V.clip_to_norm("x", 0.5).alias("c"))
    return clipped.select("vec_id", _micro_scalar(F.col("c.norm")).alias("norm"), _micro("c.clipped").alias("clipped"))


_MSE_SQL = f"""{O.GAUSSIANS},
errors as (select vec_id, label, list_sum(list_transform(list_zip(mu, log_var), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as sse,
   len(mu) as n from gaussians)
"""


@query(
    f"""with {_MSE_SQL} select vec_id, {O.micro_scalar('sse / n')} as mse from errors"""
)
def mse(spark, sf_dir):
    """Squared error between the halves of every vector."""
    return inputs.gaussians(spark, sf_dir).select("vec_id", _micro_scalar(V.mse("mu", "log_var")).alias("mse"))


@query(f"with {_MSE_SQL} select label::bigint as label, round(sum(sse) / sum(n), 6) as mse from errors group by label")
def mse_by_label(spark, sf_dir):
    """The same over all elements per label."""
    df = latents.overall_mse(inputs.gaussians(spark, sf_dir), "mu", "log_var", ("label",))
    return df.select("label", F.round("mse", 6).alias("mse"))


@query(
    f"""with {O.GAUSSIANS}, k as (select vec_id // 3 as example_id,
       -0.5 * list_sum(list_transform(list_zip(mu, log_var), lambda p: 1 + p[2] - p[1] * p[1] - exp(p[2]))) / len(mu) as kl from gaussians)
    select example_id, {O.micro_scalar('avg(kl)')} as kl from k group by example_id"""
)
def kl_stat(spark, sf_dir):
    """KL statistic averaged over three segments per example."""
    segments = inputs.gaussians(spark, sf_dir).withColumn("example_id", F.floor(F.col("vec_id") / 3).cast("long"))
    df = latents.mean_kl(segments, "mu", "log_var", ("example_id",))
    return df.select("example_id", _micro_scalar(F.col("kl")).alias("kl"))


@query(
    """select count(x) as elements, round(avg(x), 6) as shift_factor, round(1 / stddev_samp(x), 6) as scale_factor
    from (select unnest(embedding)::double as x from embeddings)"""
)
def latent_stats(spark, sf_dir):
    """Shift and scale over all vector elements."""
    df = latents.latent_statistics(inputs.table(spark, sf_dir, "embeddings"), "embedding")
    return df.select("elements", F.round("shift_factor", 6).alias("shift_factor"), F.round("scale_factor", 6).alias("scale_factor"))


_REPARAM = f"p[1] + {O.normal('z-eps', ['vec_id'], 'p[3]')} * exp(p[2] / 2)"


@query(
    f"""with {O.GAUSSIANS}, z as (select vec_id, mu, log_var, list_zip(mu, log_var, range(len(mu))) as parts from gaussians)
    select vec_id, {O.micro(f'list_transform(parts, lambda p: {_REPARAM})')} as drawn,
      {O.micro(f"list_transform(parts, lambda p: {_REPARAM} + 0.3::double * {O.normal('z-extra', ['vec_id'], 'p[3]')})")} as sample,
      {O.micro('mu')} as mean from z"""
)
def reparam(spark, sf_dir):
    """Gaussian draws per vector, with and without extra noise, and the mean."""
    return inputs.gaussians(spark, sf_dir).select(
        "vec_id",
        _micro(V.reparameterize("mu", "log_var", "z", "vec_id")).alias("drawn"),
        _micro(V.latent_view("mu", "log_var", "sample", "z", "vec_id")).alias("sample"),
        _micro(V.latent_view("mu", "log_var", "mean", "z", "vec_id")).alias("mean"),
    )


@query(
    f"""select vec_id, i as part, {O.micro('embedding[i * 16 + 1:(i + 1) * 16]')} as values, true as restored
    from embeddings, (select unnest(range(4)) as i)"""
)
def reshape(spark, sf_dir):
    """Every vector as rows of sixteen, and back."""
    shaped = inputs.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", V.reshape("embedding", 16).alias("m"))
    rows = shaped.select(
        "vec_id", F.posexplode("m").alias("part", "v"), (F.flatten("m") == F.col("embedding")).alias("restored")
    )
    return rows.select("vec_id", "part", _micro("v").alias("values"), "restored")
