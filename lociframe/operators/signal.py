"""Binned signal: pooling, clipping, baselines, gaps and smoothing, as expressions and aggregates over long tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.operators.quantiles import wide

#: The largest finite half-precision value.
HALF = 65504.0

POOLS = ("sum", "sum_sqrt", "mean", "mean_sqrt", "median", "max", "peak")


def pool_intervals(df: DataFrame, width: int, key: str = "key", start: str = "start", end: str = "end", value: str = "value") -> DataFrame:
    """(key, bin, total, n): valued intervals summed over fixed bins, each by the positions it has there."""
    bins = F.sequence(F.floor(F.col(start) / width).cast("bigint"), F.floor((F.col(end) - 1) / width).cast("bigint"))
    cut = df.select(key, start, end, value, F.explode(bins).alias("bin"))
    held = F.least(F.col(end), (F.col("bin") + 1) * width) - F.greatest(F.col(start), F.col("bin") * width)
    return cut.groupBy(key, "bin").agg(F.sum(F.col(value) * held).alias("total"), F.count("*").alias("n"))


def damped(x: Column) -> Column:
    """-1 + sqrt(1 + x); null below -1."""
    return F.when(x >= -1, F.sqrt(x + 1) - 1)


def pool(value: Column, stat: str) -> Column:
    """An aggregate of the values of a bin; nulls count as zero where the statistic is a sum or mean over positions."""
    filled = F.coalesce(value, F.lit(0.0))
    made = {
        "sum": F.sum(filled), "sum_sqrt": damped(F.sum(filled)), "mean": F.avg(filled), "avg": F.avg(filled),
        "mean_sqrt": damped(F.avg(filled)), "avg_sqrt": damped(F.avg(filled)),
        "median": F.percentile(filled, F.lit(0.5)), "max": F.max(filled), "peak": F.least(F.sqrt(F.greatest(4 * F.avg(filled), F.lit(0.0))), F.lit(1.0)),
    }
    if stat not in made:
        raise ValueError(f"unknown statistic {stat}")
    return made[stat]


def pooled(df: DataFrame, width: int, stats: list[str], keys: list[str], pos: str = "pos", value: str = "value") -> DataFrame:
    """One row for each key and bin of this width, with a column for each statistic."""
    return df.groupBy(*keys, F.floor(F.col(pos) / width).cast("bigint").alias("bin")).agg(*[pool(F.col(value), s).alias(s) for s in stats])


def soft_clip(x: Column, c: float) -> Column:
    """Above c, c - 1 + sqrt(x - c + 1)."""
    return F.when(x > c, c - 1 + F.sqrt(F.greatest(x - c + 1, F.lit(0.0)))).otherwise(x)


def hard_clip(x: Column, c: float = HALF) -> Column:
    return F.greatest(F.least(x, F.lit(float(c))), F.lit(-float(c)))


def clip_at_percentile(df: DataFrame, p: float, value: str = "value", out: str = "value") -> DataFrame:
    """Values clipped at both signs of the table's percentile, which is found over any number of tasks; one row is
    broadcast."""
    top = wide(df, [], value, {"__top": p})
    return df.crossJoin(F.broadcast(top)).withColumn(out, F.greatest(F.least(F.col(value), F.col("__top")), -F.col("__top"))).drop("__top")


def cap_masked(df: DataFrame, p: float, group: list[str], value: str = "value", mask: str = "masked", spread: bool = False) -> DataFrame:
    """Masked values are at most the percentile of their group. The percentiles are aggregated, not windowed, so that a
    large group is combined before it is shuffled; spread: its values may fill any number of tasks."""
    caps = wide(df, group, value, {"__cap": p}, spread)
    return df.join(caps, group).withColumn(value, F.when(F.col(mask), F.least(value, "__cap")).otherwise(F.col(value))).drop("__cap")


def baselined(df: DataFrame, p: float, group: list[str], value: str = "value", blacklisted: str = "blacklisted", least: int = 8, spread: bool = False) -> DataFrame:
    """Per group, the baseline is the percentile of the values if it has enough of them, else 0; blacklisted values are
    clamped between both signs of it, nulls take it."""
    sizes = df.groupBy(*group).agg(F.count(value).alias("__size"))
    base = sizes.join(wide(df, group, value, {"__q": p}, spread), group, "left").select(*group, F.when(F.col("__size") >= least, F.col("__q")).otherwise(0.0).alias("__b"))
    x = F.col(value)
    clamped = F.when(F.col(blacklisted), F.greatest(F.least(x, F.col("__b")), -F.col("__b"))).otherwise(x)
    return df.join(base, group).withColumn(value, F.when(x.isNull(), F.col("__b")).otherwise(clamped)).withColumnRenamed("__b", "baseline")


def interpolated(df: DataFrame, key: str = "key", pos: str = "pos", value: str = "value") -> DataFrame:
    """Nulls between two values take the line between them; those at the ends take zero."""
    w = Window.partitionBy(key).orderBy(pos)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(value).alias("v")))
    a, b = F.last(known, True).over(back), F.first(known, True).over(ahead)
    line = F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * (F.col(pos) - F.col("__a.p")) / (F.col("__b.p") - F.col("__a.p"))
    out = df.withColumns({"__a": a, "__b": b})
    return out.withColumn(value, F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("__a").isNull() | F.col("__b").isNull(), 0.0).otherwise(line)).drop("__a", "__b")


def moving_mean(df: DataFrame, points: int, key: str = "key", pos: str = "pos", value: str = "value", out: str = "smooth") -> DataFrame:
    """Mean of the rows around each; at the ends of those that there are."""
    half = points // 2
    return df.withColumn(out, F.avg(value).over(Window.partitionBy(key).orderBy(pos).rowsBetween(-half, points - 1 - half)))


def gaussian(df: DataFrame, sd: float, key: str = "key", pos: str = "pos", value: str = "value", out: str = "smooth", reach: float = 4.0) -> DataFrame:
    """Sparse signal spread by a normalised Gaussian kernel of up to reach deviations: each row is dealt to the positions
    around it and summed there, so work is rows times the kernel, with partial sums before the shuffle."""
    n = int(reach * sd + 0.5)
    kernel = [math.exp(-0.5 * (k / sd) ** 2) for k in range(-n, n + 1)]
    total = sum(kernel)
    taps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w / total).alias("w")) for k, w in zip(range(-n, n + 1), kernel)])
    spread = df.select(key, pos, value, F.explode(taps).alias("t")).select(key, (F.col(pos) + F.col("t.k")).alias(pos), (F.col(value) * F.col("t.w")).alias(value))
    return spread.groupBy(key, pos).agg(F.sum(value).alias(out))


def smoothed_at(df: DataFrame, sites: DataFrame, sd: float, key: str = "key", pos: str = "pos", value: str = "value", site: str = "site") -> DataFrame:
    """(key, site, score): mean of values within four deviations of each site, weighted by a Gaussian of the distance."""
    width = max(1, int(4 * sd))
    near = F.explode(F.array(*[F.floor(F.col(site) / width) + k for k in (-1, 0, 1)]))
    a = sites.withColumn("__bin", near)
    b = df.withColumn("__bin", F.floor(F.col(pos) / width))
    gap = F.col(pos) - F.col(site)
    met = a.join(b, [key, "__bin"]).where(F.abs(gap) <= 4 * sd).withColumn("__w", F.exp(-0.5 * F.pow(gap / sd, F.lit(2.0))))
    return met.groupBy(key, site).agg((F.sum(F.col("__w") * F.col(value)) / F.sum("__w")).alias("score"))


def varying(df: DataFrame, group: list[str], value: str = "value", least: float = 1e-6) -> DataFrame:
    """Groups whose sum is not zero and whose variance is above the least."""
    return df.groupBy(*group).agg(F.sum(value).alias("total"), F.var_pop(value).alias("variance")).where((F.col("total") != 0) & (F.col("variance") > least))


def high_variance(df: DataFrame, share: float, group: list[str], value: str = "value") -> DataFrame:
    """The share of groups with the highest variance."""
    spread = df.groupBy(*group).agg(F.var_pop(value).alias("variance"))
    top = wide(spread, [], "variance", {"__t": 1 - share})
    return spread.crossJoin(F.broadcast(top)).where(F.col("variance") >= F.col("__t")).drop("__t")
