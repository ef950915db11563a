"""Contact maps as long tables of (i, j, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociframe.operators.quantiles import wide


def outer(df: DataFrame, keys: list[str], i: str = "i", value: str = "v") -> DataFrame:
    """(keys, i, j, apart, mean, max, dot, geodot): every two positions of a key, both ways round."""
    a = df.select(*keys, F.col(i).alias("i"), F.col(value).alias("__a"))
    b = df.select(*keys, F.col(i).alias("j"), F.col(value).alias("__b"))
    x, y = F.col("__a"), F.col("__b")
    made = a.join(b, keys).withColumns({"apart": F.abs(F.col("i") - F.col("j")), "mean": (x + y) / 2, "max": F.greatest(x, y), "dot": x * y, "geodot": F.when((x >= -1) & (y >= -1), F.sqrt((x + 1) * (y + 1)) - 1)})
    return made.drop("__a", "__b")


def upper_triangle(df: DataFrame, offset: int = 2) -> DataFrame:
    return df.where(F.col("j") - F.col("i") >= offset)


def packed_index(df: DataFrame, size: int, offset: int = 2) -> DataFrame:
    """df with k: the place in the packed upper triangle, row by row."""
    i, j = F.col("i"), F.col("j")
    n = F.lit(size - offset)
    return upper_triangle(df, offset).withColumn("k", (i * n - F.floor(i * (i - 1) / 2) + (j - i - offset)).cast("bigint"))


def symmetric(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(M + transposed M) / 2; the diagonal counts once."""
    flipped = df.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), value)
    return df.select(*keys, "i", "j", value).unionByName(flipped).groupBy(*keys, "i", "j").agg((F.sum(value) / 2).alias(value))


def filled(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The full map of a packed upper triangle; the diagonal is not doubled."""
    flipped = df.where("i != j").select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), value)
    return df.select(*keys, "i", "j", value).unionByName(flipped)


def without_bins(df: DataFrame, bins: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and columns of the listed bins (keys, bin) left out."""
    for side in ("i", "j"):
        df = df.join(bins.select(*keys, F.col("bin").alias(side)), [*keys, side], "left_anti")
    return df


def clipped_by_diagonal(df: DataFrame, keys: list[str], value: str = "value", times: float = 10.0, spread: bool = False) -> DataFrame:
    """Values at most so many times the median of their diagonal."""
    placed = df.withColumn("__d", F.abs(F.col("i") - F.col("j")))
    tops = wide(placed, [*keys, "__d"], value, {"__t": 0.5}, spread)
    return placed.join(tops, [*keys, "__d"]).withColumn(value, F.least(F.col(value), F.col("__t") * times)).drop("__d", "__t")


def read_map(df: DataFrame, masked: DataFrame, keys: list[str], factor: int = 1, sd: float = 0.0, most: float | None = None, value: str = "value") -> DataFrame:
    """A raw map (keys, i, j, value; its upper triangle) as an example's target: without the masked bins, clipped by
    diagonal, coarsened, observed over expected as a logarithm, smoothed, and clipped at both signs of most."""
    made = clipped_by_diagonal(without_bins(df, masked, keys), keys, value)
    made = coarsened(made, keys, factor, value) if factor > 1 else made
    made = observed_over_expected(made, keys, value, log=True)
    made = blurred(made.where(F.col(value).isNotNull()), keys, sd, value) if sd else made
    return made if most is None else made.withColumn(value, F.greatest(F.least(F.col(value), F.lit(most)), F.lit(-most)))


def coarsened(df: DataFrame, keys: list[str], factor: int, value: str = "value") -> DataFrame:
    return df.groupBy(*keys, F.floor(F.col("i") / factor).alias("i"), F.floor(F.col("j") / factor).alias("j")).agg(F.avg(value).alias(value))


def observed_over_expected(df: DataFrame, keys: list[str], value: str = "value", log: bool = False, most: float | None = None) -> DataFrame:
    """Values by the mean of their diagonal, which is aggregated before it is joined; where log, their logarithm; clipped
    at both signs of most."""
    means = df.groupBy(*keys, F.abs(F.col("i") - F.col("j")).alias("__d")).agg(F.avg(value).alias("__e"))
    ratio = F.col(value) / F.nullif(F.col("__e"), F.lit(0.0))
    ratio = F.log(F.when(ratio > 0, ratio)) if log else ratio
    if most is not None:
        ratio = F.greatest(F.least(ratio, F.lit(most)), F.lit(-most))
    return df.withColumn("__d", F.abs(F.col("i") - F.col("j"))).join(means, [*keys, "__d"]).withColumn(value, ratio).drop("__d", "__e")


def blurred(df: DataFrame, keys: list[str], sd: float, value: str = "value", reach: float = 4.0) -> DataFrame:
    """A Gaussian blur with weights renormalised over the cells that there are; two passes, one for each axis."""
    import math

    n = int(reach * sd + 0.5)
    taps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(math.exp(-0.5 * (k / sd) ** 2)).alias("w")) for k in range(-n, n + 1)])
    out = df.select(*keys, "i", "j", F.col(value).alias("__v"), F.lit(1.0).alias("__w"))
    for a, b in (("i", "j"), ("j", "i")):
        spread = out.select(*keys, b, "__v", "__w", a, F.explode(taps).alias("t")).select(*keys, b, (F.col(a) + F.col("t.k")).alias(a), (F.col("__v") * F.col("t.w")).alias("__v"), (F.col("__w") * F.col("t.w")).alias("__w"))
        out = spread.groupBy(*keys, "i", "j").agg(F.sum("__v").alias("__v"), F.sum("__w").alias("__w"))
    return df.select(*keys, "i", "j").join(out, [*keys, "i", "j"]).select(*keys, "i", "j", (F.col("__v") / F.col("__w")).alias(value))


def cropped(df: DataFrame, crop: int, size: int) -> DataFrame:
    """Without so many bins at each end; numbering starts anew."""
    kept = df.where(F.col("i").between(crop, size - crop - 1) & F.col("j").between(crop, size - crop - 1))
    return kept.withColumns({"i": F.col("i") - crop, "j": F.col("j") - crop})


def reversed_bins(df: DataFrame, size: int) -> DataFrame:
    """The map of the reverse complement: both axes turned round, the triangle kept."""
    return df.withColumns({"i": size - 1 - F.col("j"), "j": size - 1 - F.col("i")})


def diagonal_ranks(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """df with the rank of each value within its diagonal."""
    w = Window.partitionBy(*keys, F.col("j") - F.col("i")).orderBy(value)
    return df.withColumn("rank", F.rank().over(w))
