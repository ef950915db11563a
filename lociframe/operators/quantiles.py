"""Exact percentiles, also of groups too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.operators.intervals import overlap_join
from lociframe.operators.ordered import running_sums


def percentiles(df: DataFrame, group: list[str], value: str, shares: list[float], spread: bool = True) -> DataFrame:
    """(group, k, percentile, value): these percentiles over all rows of each group, by interpolation. Distinct values are
    counted and ranked (spread: over any number of tasks), and each point takes the two values around its rank, so no task
    holds a group's values."""
    held = df.where(F.col(value).isNotNull())
    counted = held.groupBy(*group, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    ranked = running_sums(counted, group, "__v", {"__upto": "__n"}, spread)
    key = F.struct(*group) if group else F.lit(0)
    at = F.split(F.lit(",".join(map(str, shares))), ",").cast("array<double>")
    points = held.groupBy(*group).agg(F.count("*").alias("__rows")).select(key.alias("key"), "__rows", F.posexplode(at).alias("k", "percentile"))
    points = points.withColumn("__at", F.col("percentile") * (F.col("__rows") - 1))
    wanted = points.select("key", "k", "percentile", (F.col("__at") - F.floor("__at")).alias("__part"), F.explode(F.array(F.struct(F.floor("__at").alias("r"), F.lit(0).alias("side")), F.struct(F.least(F.floor("__at") + 1, F.col("__rows") - 1).alias("r"), F.lit(1).alias("side")))).alias("w"))
    wanted = wanted.select("key", "k", "percentile", "__part", "w.side", F.col("w.r").alias("b_start"), (F.col("w.r") + 1).alias("b_end"))
    spans = ranked.select(key.alias("key"), "__v", (F.col("__upto") - F.col("__n")).alias("a_start"), F.col("__upto").alias("a_end"))
    met = overlap_join(spans, wanted, width=4096)
    low, high = F.max(F.when(F.col("side") == 0, F.col("__v"))), F.max(F.when(F.col("side") == 1, F.col("__v")))
    done = met.groupBy("key", "k", "percentile", "__part").agg(low.alias("__a"), high.alias("__b"))
    return done.select(*(["key.*"] if group else []), "k", "percentile", (F.col("__a") + F.col("__part") * (F.col("__b") - F.col("__a"))).alias("value"))


def wide(df: DataFrame, group: list[str], value: str, shares: dict[str, float], spread: bool = True) -> DataFrame:
    """(group, a column for each name: share). Without spread a group's distinct values meet in one task, which is the
    cheaper way for many small groups."""
    if not spread:
        return df.groupBy(*group).agg(*[F.percentile(value, F.lit(p)).alias(n) for n, p in shares.items()])
    found = percentiles(df, group, value, list(shares.values()))
    return found.groupBy(*group).agg(*[F.max(F.when(F.col("k") == k, F.col("value"))).alias(n) for k, n in enumerate(shares)])
