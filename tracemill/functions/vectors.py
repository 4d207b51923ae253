"""Latent-vector expressions and schedules. Vectors are arrays of float or double."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from . import constants as K
from .text import as_column, normal_vector, uniform_int


def _zero() -> Column:
    return F.lit(0.0)


def doubles(vector) -> Column:
    return as_column(vector).cast("array<double>")


def total(vector) -> Column:
    return F.aggregate(as_column(vector), _zero(), lambda acc, x: acc + _double(x))


def mean(vector) -> Column:
    return F.try_divide(total(vector), F.size(as_column(vector)))


def _double(x: Column) -> Column:
    return x.cast("double")


def difference(a, b) -> Column:
    """a - b in double precision, without widened copies of the inputs."""
    return F.zip_with(as_column(a), as_column(b), lambda x, y: _double(x) - _double(y))


def squared_error(a, b) -> Column:
    return F.aggregate(difference(a, b), _zero(), lambda acc, d: acc + d * d)


def mse(a, b) -> Column:
    return F.try_divide(squared_error(a, b), F.size(as_column(a)))


def l2_norm(vector) -> Column:
    return F.sqrt(F.aggregate(as_column(vector), _zero(), lambda acc, x: acc + _double(x) * _double(x)))


def rescale(vector, shift: float, scale: float, mode: str = "encode") -> Column:
    """(z - shift) * scale, or its inverse with mode="decode". Shift 0 is the scale-only form."""
    if mode == "encode":
        return F.transform(as_column(vector), lambda z: (_double(z) - shift) * scale)
    if mode == "decode":
        return F.transform(as_column(vector), lambda z: _double(z) / scale + shift)
    raise ValueError(f"unknown rescale mode: {mode}")


def noise_like(vector, seed, *keys) -> Column:
    return normal_vector(F.size(as_column(vector)), seed, *keys)


def add_noise(vector, noise) -> Column:
    """The live noising rule: plain addition, independent of the timestep."""
    return F.zip_with(as_column(vector), as_column(noise), lambda x, e: _double(x) + _double(e))


def training_target(vector, noise, prediction: str = "flow") -> Column:
    if prediction == "epsilon":
        return doubles(noise)
    if prediction == "sample":
        return doubles(vector)
    if prediction == "flow":
        return difference(noise, vector)
    raise ValueError(f"unknown prediction type: {prediction}")


def random_timestep(seed, *keys) -> Column:
    return uniform_int(K.TRAIN_TIMESTEPS, seed, *keys)


def timestep_grid(steps) -> Column:
    """Integer timesteps from the last training step down to 0, evenly spaced and truncated."""
    steps = F.lit(steps) if isinstance(steps, int) else as_column(steps)
    top = K.TRAIN_TIMESTEPS - 1
    return F.when(steps == 1, F.array(F.lit(top))).otherwise(
        F.transform(
            F.sequence(F.lit(0), steps - 1),
            lambda i: F.floor(F.lit(top) * (steps - 1 - i) / F.greatest(steps - 1, F.lit(1))).cast("int"),
        )
    )


def sigma_grid(steps) -> Column:
    steps = F.lit(steps) if isinstance(steps, int) else as_column(steps)
    return F.transform(F.sequence(F.lit(0), steps), lambda i: 1.0 - i / steps)


def trajectory_timesteps(steps) -> Column:
    """The grid followed by the final 0, one entry per logged state."""
    return F.concat(timestep_grid(steps), F.array(F.lit(0)))


def sinusoid(number, size: int, max_period: float = 10000.0) -> Column:
    """`size` features: cosines, then sines, of geometrically spaced frequencies; 0 fills an odd size."""
    number = as_column(number).cast("double")
    half = size // 2
    frequencies = [math.exp(-math.log(max_period) * k / max(half, 1)) for k in range(half)]
    parts = [F.cos(number * w) for w in frequencies] + [F.sin(number * w) for w in frequencies]
    return F.array(*parts, *[_zero()] * (size - 2 * half))


def clip_to_norm(vector, max_norm: float, floor: float = 1e-6) -> Column:
    """struct<norm, clipped>: non-finite elements become 0, the norm is floored, and vectors longer
    than `max_norm` are scaled down to it (0 or less turns clipping off)."""
    finite = F.transform(
        doubles(vector),
        lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), _zero()).otherwise(F.coalesce(x, _zero())),
    )

    def scaled(clean: Column) -> Column:
        norm = F.greatest(l2_norm(clean), F.lit(floor))
        factor = F.least(F.lit(max_norm) / norm, F.lit(1.0)) if max_norm > 0 else F.lit(1.0)
        return F.transform(
            F.array(F.struct(norm.alias("norm"), factor.alias("factor"))),
            lambda s: F.struct(s["norm"].alias("norm"), F.transform(clean, lambda x: x * s["factor"]).alias("clipped")),
        )

    return F.flatten(F.transform(F.array(finite), scaled))[0]


def kl_to_standard_normal(mu, log_var) -> Column:
    """Mean (not sum) over elements of the diagonal-Gaussian KL term."""
    terms = F.zip_with(doubles(mu), doubles(log_var), lambda m, v: 1.0 + v - m * m - F.exp(v))
    return -0.5 * mean(terms)


def reparameterize(mu, log_var, seed, *keys, extra_noise: float = 0.0) -> Column:
    """mu + eps * exp(log_var / 2), optionally with a further scaled normal draw."""
    eps = noise_like(mu, f"{seed}-eps", *keys)
    drawn = F.zip_with(
        doubles(mu), F.zip_with(doubles(log_var), eps, lambda v, e: e * F.exp(v / 2)), lambda m, d: m + d
    )
    if not extra_noise:
        return drawn
    extra = noise_like(mu, f"{seed}-extra", *keys)
    return F.zip_with(drawn, extra, lambda d, e: d + e * extra_noise)


def latent_view(mu, log_var, mode: str, seed, *keys) -> Column:
    """What an encoder returns: "mean", a noisy "sample", or the "parameters" themselves."""
    if mode == "mean":
        return doubles(mu)
    if mode == "sample":
        return reparameterize(mu, log_var, seed, *keys, extra_noise=K.SAMPLE_NOISE)
    if mode == "parameters":
        return F.struct(doubles(mu).alias("mu"), doubles(log_var).alias("log_var"))
    raise ValueError(f"unknown latent mode: {mode}")


def reshape(vector, dim: int = K.LATENT_DIM) -> Column:
    """Flat vector to rows of `dim` elements (F.flatten is the way back)."""
    vector = as_column(vector)
    rows = F.floor(F.size(vector) / dim).cast("int")
    return F.transform(F.sequence(F.lit(0), rows - 1), lambda i: F.slice(vector, i * dim + 1, F.lit(dim)))


# Scores ----------------------------------------------------------------------


def sigmoid(logit) -> Column:
    return 1.0 / (1.0 + F.exp(-as_column(logit)))


def bce_with_logits(logit, label) -> Column:
    """Binary cross entropy in the form that does not overflow."""
    x, y = as_column(logit), as_column(label)
    return F.greatest(x, _zero()) - x * y + F.log1p(F.exp(-F.abs(x)))
