"""Accuracy and rank statistics per target, from mergeable sums where the statistic allows it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.operators.ordered import dealt, mid_ranks, numbered, running, running_sums


def moments(y: str, p: str) -> list[Column]:
    """Partial sums that merge: n, sums of y, p, their squares and their product. Rows with a null are left out."""
    held = F.col(y).isNotNull() & F.col(p).isNotNull()
    a, b = F.when(held, F.col(y).cast("double")), F.when(held, F.col(p).cast("double"))
    return [F.count(a).alias("n"), F.sum(a).alias("sy"), F.sum(b).alias("sp"), F.sum(a * a).alias("syy"), F.sum(b * b).alias("spp"), F.sum(a * b).alias("syp")]


def pearson_of(tiny: float = 1e-12) -> Column:
    """Correlation from the sums; 0 where either has no variance."""
    n, vy, vp = F.col("n"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n"), F.col("spp") - F.col("sp") * F.col("sp") / F.col("n")
    return F.when((n > 0) & (vy > tiny) & (vp > tiny), (F.col("syp") - F.col("sy") * F.col("sp") / n) / F.sqrt(vy * vp)).otherwise(0.0)


def r2_of() -> Column:
    """1 - residual / total sum of squares; null where y has no variance."""
    total = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return F.when(total > 0, 1 - (F.col("spp") - 2 * F.col("syp") + F.col("syy")) / total)


def explained_variance_of() -> Column:
    n = F.col("n")
    total = F.col("syy") / n - F.pow(F.col("sy") / n, F.lit(2.0))
    apart = (F.col("syy") - 2 * F.col("syp") + F.col("spp")) / n - F.pow((F.col("sy") - F.col("sp")) / n, F.lit(2.0))
    return F.when(total > 0, 1 - apart / total)


def accuracy(df: DataFrame, target: list[str], y: str, p: str) -> DataFrame:
    """(target, n, pearsonr, r2, explained): one pass, partial sums before the shuffle."""
    return df.groupBy(*target).agg(*moments(y, p)).select(*target, "n", pearson_of().alias("pearsonr"), r2_of().alias("r2"), explained_variance_of().alias("explained"))


def spearman(df: DataFrame, target: list[str], y: str, p: str, spread: bool = False) -> DataFrame:
    """Correlation of average ranks."""
    held = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    a = mid_ranks(held, target, y, spread).select(*target, y, F.col("rank").alias("__ry"))
    b = mid_ranks(held, target, p, spread).select(*target, p, F.col("rank").alias("__rp"))
    ranked = held.join(a, [*target, y]).join(b, [*target, p])
    return ranked.groupBy(*target).agg(*moments("__ry", "__rp")).select(*target, "n", pearson_of().alias("spearmanr"))


def auroc(df: DataFrame, target: list[str], label: str, score: str, spread: bool = False) -> DataFrame:
    """Area under the ROC curve by the rank sum; 0.5 where a class is empty. Rows without a score are left out."""
    held = df.where(F.col(score).isNotNull())
    positive = F.when(F.col(label), 1).otherwise(0).cast("bigint")
    counted = held.groupBy(*target, score).agg(F.count("*").alias("n"), F.sum(positive).alias("pos"))
    done = running_sums(counted, target, score, {"__upto": "n"}, spread)
    sums = done.groupBy(*target).agg(F.sum("n").alias("n"), F.sum("pos").alias("np"), F.sum(F.col("pos") * (F.col("__upto") - (F.col("n") - 1) / 2)).alias("r"))
    nn = F.col("n") - F.col("np")
    area = (F.col("r") - F.col("np") * (F.col("np") + 1) / 2) / (F.col("np") * nn)
    return sums.select(*target, "n", F.col("np").alias("positives"), F.when((F.col("np") > 0) & (nn > 0), area).otherwise(0.5).alias("auroc"))


def auprc(df: DataFrame, target: list[str], label: str, score: str, spread: bool = False) -> DataFrame:
    """Average precision: the sum over falling scores of the recall gained times the precision there; 0 without
    positives."""
    positive = F.when(F.col(label), 1).otherwise(0).cast("bigint")
    counted = df.where(F.col(score).isNotNull()).groupBy(*target, (-F.col(score)).alias("__s")).agg(F.count("*").alias("n"), F.sum(positive).alias("pos"))
    done = running_sums(counted, target, "__s", {"__all": "n", "__tp": "pos"}, spread)
    sums = done.groupBy(*target).agg(F.sum("pos").alias("np"), F.sum(F.col("pos") * F.col("__tp") / F.col("__all")).alias("a"))
    return sums.select(*target, F.when(F.col("np") > 0, F.col("a") / F.col("np")).otherwise(0.0).alias("auprc"))


def benjamini_hochberg(df: DataFrame, group: list[str], p: str = "p", order: list[str] | None = None, legacy: bool = False, spread: bool = False) -> DataFrame:
    """df with q: the step-up false discovery rate. legacy: floor(p * m / rank), without the step-up. spread: a group may
    fill any number of tasks."""
    if spread and not legacy:  # equal p have one q, that of their last rank
        counted = df.groupBy(*group, p).agg(F.count("*").alias("__n"))
        sizes = counted.groupBy(*group).agg(F.sum("__n").alias("__m"))
        ranked = running_sums(counted, group, p, {"__upto": "__n"}, True)
        ranked = ranked.join(sizes, group) if group else ranked.crossJoin(F.broadcast(sizes))
        raw = ranked.select(*group, p, (-F.col(p)).alias("__down"), (F.col(p) * F.col("__m") / F.col("__upto")).alias("__raw"))
        above = running(dealt(raw, group, "__down", True), group, ["__down"], {"__least": ("max", -F.col("__raw"))}, True)
        q = above.select(*group, F.col(p).alias("__p"), F.least(F.col("__raw"), -F.col("__least"), F.lit(1.0)).alias("q"))
        same = F.lit(True)
        for c in group:
            same = same & df[c].eqNullSafe(q[c])
        return df.join(q, same & (df[p] == q["__p"])).select(*[df[c] for c in df.columns], "q")
    w = Window.partitionBy(*group)
    ranked = df.withColumns({"__m": F.count("*").over(w), "__k": F.row_number().over(w.orderBy(p, *(order or [])))})
    raw = F.col(p) * F.col("__m") / F.col("__k")
    if legacy:
        return ranked.withColumn("q", F.floor(raw).cast("double")).drop("__m", "__k")
    least = F.min(raw).over(w.orderBy(F.desc("__k")).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("q", F.least(least, F.lit(1.0))).drop("__m", "__k")


def quantile_normalised(df: DataFrame, row: list[str], column: str, value: str, stat: str = "mean", spread: bool = False) -> DataFrame:
    """Within each column, the value of rank k becomes the mean (or median) over columns of their k-th values; ties by
    row. spread: a column's ranks are taken over any number of tasks."""
    ranked = numbered(df.withColumn("__o", F.struct(value, *row)), [column], ["__o"], "__k", spread).drop("__o")
    level = F.avg(value) if stat == "mean" else F.percentile(value, F.lit(0.5))
    return ranked.drop(value).join(ranked.groupBy("__k").agg(level.alias(value)), "__k").drop("__k")


def poisson_multinomial(df: DataFrame, group: list[str], y: str, p: str, total_weight: float = 1.0, epsilon: float = 1e-6) -> DataFrame:
    """Loss of each group: Poisson of the totals, and multinomial of the shape, each by the number of positions."""
    a, b = F.col(y) + epsilon, F.col(p) + epsilon
    sums = df.groupBy(*group).agg(F.count("*").alias("n"), F.sum(y).alias("sy"), F.sum(p).alias("sp"), F.sum(b).alias("sb"), F.sum(a * F.log(b)).alias("cross"), F.sum(a).alias("sa"))
    poisson = (F.col("sp") - F.col("sy") * F.log(F.col("sp") + epsilon)) / F.col("n")
    shape = -(F.col("cross") - F.col("sa") * F.log("sb")) / F.col("n")
    return sums.select(*group, (shape + total_weight * poisson).alias("loss"), poisson.alias("poisson"), shape.alias("shape"))


def poisson_kl(df: DataFrame, group: list[str], y: str, p: str, kl_weight: float = 1.0, epsilon: float = 1e-3) -> DataFrame:
    """Mean Poisson loss, plus the divergence of the normalised vectors."""
    a, b = F.col(y) + epsilon, F.col(p) + epsilon
    sums = df.groupBy(*group).agg(F.avg(F.col(p) - F.col(y) * F.log(b)).alias("poisson"), F.sum(a).alias("sa"), F.sum(b).alias("sb"), F.sum(a * F.log(a / b)).alias("c"))
    kl = F.col("c") / F.col("sa") - F.log(F.col("sa") / F.col("sb"))
    return sums.select(*group, (F.col("poisson") + kl_weight * kl).alias("loss"), F.col("poisson"), kl.alias("kl"))


def mse_udot(df: DataFrame, group: list[str], y: str, p: str, weight: float = 1.0) -> DataFrame:
    """Mean squared error less the weighted mean product."""
    error = F.avg(F.pow(F.col(y) - F.col(p), F.lit(2.0)))
    return df.groupBy(*group).agg((error - weight * F.avg(F.col(y) * F.col(p))).alias("loss"))


def _log_factorial(k: Column) -> Column:
    """Less k * log(k) - k, by Stirling's series; from 10 on it is exact to double precision."""
    x = 1 / k
    series = x / 12 - F.pow(x, F.lit(3.0)) / 360 + F.pow(x, F.lit(5.0)) / 1260 - F.pow(x, F.lit(7.0)) / 1680 + F.pow(x, F.lit(9.0)) / 1188
    small = F.log(F.factorial(F.least(k, F.lit(10.0)).cast("int")).cast("double")) - k * F.log(k) + k
    return F.when(k < 10, small).otherwise(0.5 * F.log(2 * F.pi() * k) + series)


def _poisson_mass(k: Column, rate: Column) -> Column:
    """P(X = k), k from 1, without the cancellation of large logarithms."""
    return F.exp(k * F.log1p((rate - k) / k) + (k - rate) - _log_factorial(k))


def poisson_tail(k: Column, rate: Column) -> Column:
    """P(X >= k) for X Poisson, for any k and rate; zero and less give 1. The smaller tail is summed outwards from its
    largest term until terms no longer count: some nine square roots of the rate of them at most."""
    k, rate = F.ceil(k).cast("double"), rate.cast("double")
    steps = F.sequence(F.lit(1), F.ceil(9 * F.sqrt(F.greatest(k, rate)) + 60).cast("int"))

    def summed(ratio) -> Column:
        start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
        grown = lambda a, i: (a["term"] * F.greatest(ratio(i), F.lit(0.0))).alias("term")
        return F.aggregate(steps, start, lambda a, i: F.struct(grown(a, i), (a["sum"] + a["term"] * F.greatest(ratio(i), F.lit(0.0))).alias("sum")), lambda a: a["sum"])

    above = _poisson_mass(k, rate) * summed(lambda i: rate / (k + i))  # k, k + 1, ...
    below = F.when(k > 1, _poisson_mass(k - 1, rate) * summed(lambda i: (k - i) / rate)).otherwise(F.exp(-rate))  # k - 1, k - 2, ...
    tail = F.when(k > rate, above).otherwise(1 - below)
    return F.when(k <= 0, 1.0).when(rate <= 0, 0.0).otherwise(F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0)))


def called_peaks(df: DataFrame, target: list[str], y: str, order: list[str], limit: float = 0.01, spread: bool = False) -> DataFrame:
    """df with p, q and peak: counts that are improbably high for their target's mean."""
    means = df.groupBy(*target).agg(F.avg(y).alias("__rate"))
    tested = df.join(means, target).withColumn("p", poisson_tail(F.round(y), F.col("__rate"))).drop("__rate")
    return benjamini_hochberg(tested, target, "p", order, spread=spread).withColumn("peak", F.col("q") < limit)


def peak_accuracy(df: DataFrame, target: list[str], y: str, p: str, bin: str = "bin", order: list[str] | None = None, every: int = 8, limit: float = 0.01, spread: bool = False) -> DataFrame:
    """(target, n, peaks, auroc, auprc): how well predictions tell a target's peaks, which are called on every so manieth
    bin; 0.5 and 0 where it has none."""
    kept = df.where(F.col(bin) % every == 0).withColumnRenamed(p, "__pred")
    peaks = called_peaks(kept, target, y, [bin, *(order or [])], limit, spread)
    a = auroc(peaks, target, "peak", "__pred", spread).withColumnRenamed("positives", "peaks")
    return a.join(auprc(peaks, target, "peak", "__pred", spread), target)


def strata(x: Column, edges: list[float]) -> Column:
    """The number of the stratum (low, high] that x is in; null outside."""
    out = F.lit(None).cast("int")
    for k, (low, high) in enumerate(zip(edges, edges[1:])):
        out = F.when((x > low) & (x <= high), k).otherwise(out)
    return out


def signed_rank(df: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """Wilcoxon's signed rank statistic of paired differences (zeros left out), its normal approximation z with the tie
    correction, and the paired t."""
    d = df.select(*group, (F.col(a) - F.col(b)).alias("d")).where("d is not null")
    ranked = mid_ranks(d.where("d != 0").withColumn("m", F.abs("d")), group, "m")
    signs = d.where("d != 0").groupBy(*group, F.abs("d").alias("m")).agg(F.count_if(F.col("d") > 0).alias("up"))
    n = F.col("n")
    w = ranked.join(signs, [*group, "m"]).groupBy(*group).agg(F.sum("n").alias("n"), F.sum(F.col("up") * F.col("rank")).alias("w"), F.sum(n * n * n - n).alias("ties"))
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    w = w.select(*group, "n", F.col("w").alias("w_plus"), F.when(var > 0, (F.col("w") - mean) / F.sqrt(var)).alias("z"))
    t = d.groupBy(*group).agg(F.avg("d").alias("__m"), F.stddev_samp("d").alias("__s"), F.count("*").alias("__n"))
    return t.join(w, group, "left").withColumn("t", F.when(F.col("__s") > 0, F.col("__m") / (F.col("__s") / F.sqrt(F.col("__n"))))).drop("__m", "__s", "__n")


def student_t_sf(t: float, df: float) -> float:
    """P(T > t), by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d or 1e-300)
        h = d
        for m in range(1, 300):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + top * d) or 1e-300)
                c = (1 + top / c) or 1e-300
                h *= d * c
        return h

    if x >= 1:
        return 0.5
    whole = front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b
    return whole / 2 if t > 0 else 1 - whole / 2


def mean_of_means(df: DataFrame, outer: list[str], inner: list[str], value: str) -> DataFrame:
    """Mean over files of each file's mean, with its standard error."""
    files = df.groupBy(*outer, *inner).agg(F.avg(value).alias("m"))
    return files.groupBy(*outer).agg(F.avg("m").alias("mean"), (F.stddev_samp("m") / F.sqrt(F.count("*"))).alias("sem"), F.count("*").alias("n"))
