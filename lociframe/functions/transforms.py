"""Column functions of numbers: what undoes squashing, and small helpers of the layer functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def untransform(x: Column, clip_soft: Column, rooted: Column, scale: Column | None = None) -> Column:
    """Undo the soft clip, c - 1 + (x - c + 1)^2 above c, then for rooted targets -1 + (x + 1)^(4/3), then the scale."""
    y = F.when(x > clip_soft, clip_soft - 1 + F.pow(x - clip_soft + 1, F.lit(2.0))).otherwise(x)
    y = F.when(rooted, F.pow(y + 1, F.lit(4.0 / 3)) - 1).otherwise(y)
    return y if scale is None else y / scale


def untransform_older(x: Column, clip_soft: Column, rooted: Column, scale: Column, unscale: bool = False) -> Column:
    """The older order: scale first, c + (x - c)^2 above c, then ^(4/3), then the scale again."""
    y = x / scale
    y = F.when(y > clip_soft, clip_soft + F.pow(y - clip_soft, F.lit(2.0))).otherwise(y)
    y = F.when(rooted, F.pow(y, F.lit(4.0 / 3))).otherwise(y)
    return y if unscale else y * scale


def untransform_exact(x: Column, clip_soft: Column, rooted: Column) -> Column:
    """The inverse of the pooling transforms: the soft clip, then (x + 1)^2 - 1."""
    y = F.when(x > clip_soft, clip_soft - 1 + F.pow(x - clip_soft + 1, F.lit(2.0))).otherwise(x)
    return F.when(rooted, F.pow(y + 1, F.lit(2.0)) - 1).otherwise(y)


def truncated(x: Column, decimals: int) -> Column:
    return F.floor(x * 10**decimals) / 10**decimals


def stochastic_round(x: Column, decimals: int, seed: int) -> Column:
    """Rounded up with the probability of the part that is cut off."""
    scaled = x * 10**decimals
    return (F.floor(scaled) + F.when(F.rand(seed) < scaled - F.floor(scaled), 1).otherwise(0)) / 10**decimals


def power_minus(x: Column, base: float | None = None, minus: float | None = None) -> Column:
    y = F.exp(x) if base is None else F.pow(F.lit(float(base)), x)
    return y if minus is None else y - minus


def softplus(x: Column, most: float = 10_000.0) -> Column:
    """ln(1 + e^x), with x at most so large; exact for large x as well."""
    x = F.least(x, F.lit(most))
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def centre(array: Column, n: int) -> Column:
    """The n elements in the middle."""
    return F.slice(array, F.floor((F.size(array) - n) / 2).cast("int") + 1, n)


def centre_mean(array: Column, n: int) -> Column:
    return F.aggregate(centre(array, n), F.lit(0.0), lambda a, x: a + x) / n


def every(array: Column, step: int) -> Column:
    """Each step-th element, from the first on."""
    return F.filter(array, lambda x, i: i % step == 0)


def length_mean(array: Column, held: Column) -> Column:
    """Mean over the positions that hold something."""
    zipped = F.zip_with(array, held, lambda x, h: F.when(h, x).otherwise(0.0))
    n = F.size(F.filter(held, lambda h: h))
    return F.when(n > 0, F.aggregate(zipped, F.lit(0.0), lambda a, x: a + x) / n)


def exact_sum(x: Column) -> Column:
    """The sum of doubles of up to nine decimals, the same in any order of the rows. What lies beyond those decimals, and
    numbers from 10^15 on, are added as doubles."""
    whole = F.when(F.abs(x) < 1e15, x).try_cast("decimal(24,9)")
    return F.coalesce(F.sum(whole).cast("double"), F.lit(0.0)) + F.sum(x - F.coalesce(whole.cast("double"), F.lit(0.0)))
