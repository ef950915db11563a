"""Tables of accuracy and correlation over genes, targets and replicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.operators.metrics import accuracy, moments, pearson_of, spearman
from lociframe.operators.ordered import numbered
from lociframe.operators.quantiles import wide


def correlation_table(df: DataFrame, target: list[str], y: str, p: str) -> DataFrame:
    """Per target, Pearson's and Spearman's correlation of log2(x + 1), over all rows and over those where y is not 0."""
    logs = df.select(*target, F.col(y).alias("__raw"), F.log2(F.col(y) + 1).alias("ly"), F.log2(F.col(p) + 1).alias("lp"))
    out = None
    for name, part in (("all", logs), ("nonzero", logs.where("__raw != 0"))):
        a = accuracy(part, target, "ly", "lp").select(*target, F.col("pearsonr").alias(f"pearsonr_{name}"))
        b = spearman(part, target, "ly", "lp").select(*target, F.col("spearmanr").alias(f"spearmanr_{name}"))
        both = a.join(b, target)
        out = both if out is None else out.join(both, target, "left")
    return out


def equal_buckets(df: DataFrame, value: str, n: int, id: str, group: list[str] | None = None, spread: bool = True) -> DataFrame:
    """df with quantile (from 0): buckets that end at the whole parts of an even division of the rows; value and id have
    no ties together. spread: ranks are taken over any number of tasks."""
    group = group or []
    sizes = df.groupBy(*group).agg(F.count("*").alias("__n"))
    ranked = numbered(df.withColumn("__o", F.struct(value, id)), group, ["__o"], "__k", spread).drop("__o")
    ranked = ranked.join(sizes, group) if group else ranked.crossJoin(F.broadcast(sizes))  # one row
    cut = F.least(F.floor(F.col("__k") * n / F.col("__n")), F.lit(n - 1))
    # bucket q starts at floor(q * rows / n)
    fixed = F.when(F.floor((cut + 1) * F.col("__n") / n) <= F.col("__k"), cut + 1).when(F.floor(cut * F.col("__n") / n) > F.col("__k"), cut - 1).otherwise(cut)
    return ranked.withColumn("quantile", fixed.cast("int")).drop("__k", "__n")


def accuracy_by_quantile(df: DataFrame, gene: str, target: list[str], y: str, p: str, stat: Column, n: int = 4) -> DataFrame:
    """Accuracy per target within quantiles of a statistic of the genes (an aggregate expression)."""
    genes = equal_buckets(df.groupBy(gene).agg(stat.alias("__stat")), "__stat", n, gene).select(gene, "quantile")
    return accuracy(df.join(genes, gene), [*target, "quantile"], y, p)


def gene_variance(df: DataFrame, gene: str, y: str, p: str) -> DataFrame:
    """Per gene, mean, deviation and coefficient of variation over targets, and the mean squared error."""
    return df.groupBy(gene).agg(F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"), F.avg(F.pow(F.col(y) - F.col(p), F.lit(2.0))).alias("mse")).withColumn("cv", F.when(F.col("mean") != 0, F.col("std") / F.col("mean")))


def pairwise_correlations(df: DataFrame, row: str, target: str, value: str) -> DataFrame:
    """(a, b, n, pearsonr) of every two targets over their shared rows."""
    a = df.select(row, F.col(target).alias("a"), F.col(value).alias("__x"))
    b = df.select(row, F.col(target).alias("b"), F.col(value).alias("__y"))
    return a.join(b, row).where("a < b").groupBy("a", "b").agg(*moments("__x", "__y")).select("a", "b", "n", pearson_of().alias("pearsonr"))


def cross_spearman(a: DataFrame, b: DataFrame, row: str, left: str, right: str, value: str = "value") -> DataFrame:
    """(left, right, spearmanr): features against targets over the rows; features without variance are left out."""
    varied = a.groupBy(left).agg(F.var_pop(value).alias("__v")).where("__v > 0").select(left)
    x = a.join(varied, left).select(row, left, F.col(value).alias("__x"))
    both = x.join(b.select(row, right, F.col(value).alias("__y")), row)
    return spearman(both, [left, right], "__x", "__y").select(left, right, "spearmanr")


def alternative_starts(df: DataFrame, least_distance: int = 500, least_variance: float = 0.0, gene: str = "gene_id", site: str = "tss_id", pos: str = "pos", target: str = "target_id", y: str = "y", p: str = "p") -> DataFrame:
    """(gene, a, b, n, pearsonr, t): of each gene's sites the most variable and the next that is far enough from it; the
    correlation over targets of observed and predicted log ratios, and the t statistic of the observed ones."""
    spread = df.groupBy(gene, site).agg(F.var_pop(F.log2(F.col(y) + 1)).alias("v"), F.min(pos).alias("q")).where(F.col("v") > least_variance)
    first = spread.groupBy(gene).agg(F.max_by(F.struct(F.col(site).alias("s"), "q"), F.struct("v", site)).alias("f"))
    others = spread.join(first, gene).where((F.col(site) != F.col("f.s")) & (F.abs(F.col("q") - F.col("f.q")) >= least_distance))
    chosen = others.groupBy(gene).agg(F.first("f.s").alias("a"), F.max_by(site, F.struct("v", site)).alias("b"))
    logs = df.select(gene, site, target, F.log2(F.col(y) + 1).alias("ly"), F.log2(F.col(p) + 1).alias("lp"))
    x = chosen.join(logs.withColumnsRenamed({site: "a", "ly": "ya", "lp": "pa"}), [gene, "a"])
    both = x.join(logs.withColumnsRenamed({site: "b", "ly": "yb", "lp": "pb"}), [gene, "b", target]).withColumns({"__y": F.col("ya") - F.col("yb"), "__p": F.col("pa") - F.col("pb")})
    sums = both.groupBy(gene, "a", "b").agg(*moments("__y", "__p"), F.stddev_samp("__y").alias("__s"))
    t = F.when(F.col("__s") > 0, F.col("sy") / F.col("n") / (F.col("__s") / F.sqrt(F.col("n"))))
    return sums.select(gene, "a", "b", "n", pearson_of().alias("pearsonr"), t.alias("t"))


def normalised_targets(df: DataFrame, row: str, target: str, value: str, pseudo: float = 1.0, times: float = 10.0) -> DataFrame:
    """log2(value + pseudo), without targets whose mean is over so many times the mean of all targets or under its so
    manieth part, quantile-normalised by the mean."""
    from lociframe.operators.metrics import quantile_normalised

    means = df.groupBy(target).agg(F.avg(value).alias("__m"))
    grand = means.agg(F.avg("__m").alias("__g"))
    kept = means.crossJoin(F.broadcast(grand)).where((F.col("__m") <= times * F.col("__g")) & (F.col("__m") >= F.col("__g") / times)).select(target)
    logs = df.join(kept, target).withColumn(value, F.log2(F.col(value) + pseudo))
    return quantile_normalised(logs, [row], target, value)


def varied_segments(df: DataFrame, segment: str, target: str, value: str, least: float = 0.01) -> DataFrame:
    """Segments of which some target's variance along the length is above the least."""
    per = df.groupBy(segment, target).agg(F.var_pop(value).alias("v"))
    return per.groupBy(segment).agg(F.max("v").alias("variance")).where(F.col("variance") > least)


def insertion_effects(df: DataFrame, sequence: str, motif: str, value: str = "value", base: str = "base") -> DataFrame:
    """(motif, mean, variance) over sequences of what a motif adds to the base, centred within each sequence over
    motifs."""
    d = df.withColumn("__d", F.col(value) - F.col(base))
    means = d.groupBy(sequence).agg(F.avg("__d").alias("__m"))
    return d.join(means, sequence).withColumn("__d", F.col("__d") - F.col("__m")).groupBy(motif).agg(F.avg("__d").alias("mean"), F.var_pop("__d").alias("variance"))


def roc_points(df: DataFrame, target: list[str], label: str, score: str, points: int = 256) -> DataFrame:
    """(target, k, fpr, tpr): the ROC curve at evenly spaced false positive rates, by interpolation over distinct
    scores."""
    positive = F.when(F.col(label), 1).otherwise(0)
    counted = df.where(F.col(score).isNotNull()).groupBy(*target, score).agg(F.sum(positive).alias("p"), (F.count("*") - F.sum(positive)).alias("q"))
    w = Window.partitionBy(*target)
    down = w.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    curve = counted.select(*target, (F.sum("q").over(down) / F.sum("q").over(w)).alias("x"), (F.sum("p").over(down) / F.sum("p").over(w)).alias("y"), F.col(score).alias("__s"))
    low = w.orderBy(F.desc("__s"))
    steps = curve.withColumns({"x0": F.coalesce(F.lag("x").over(low), F.lit(0.0)), "y0": F.coalesce(F.lag("y").over(low), F.lit(0.0))}).where("x > x0")
    first, last = F.ceil(F.col("x0") * (points - 1)).cast("int"), F.floor(F.col("x") * (points - 1)).cast("int")
    held = steps.select(*target, "x0", "y0", "x", "y", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))).alias("k"))
    at = F.col("k") / (points - 1)
    value = F.col("y0") + (F.col("y") - F.col("y0")) * (at - F.col("x0")) / (F.col("x") - F.col("x0"))
    return held.groupBy(*target, "k").agg(F.max(value).alias("tpr")).select(*target, "k", (F.col("k") / (points - 1)).alias("fpr"), "tpr")


def indel(ref: Column, alt: Column, absolute: bool = True) -> Column:
    d = F.length(ref) - F.length(alt)
    return F.abs(d) if absolute else d


def pseudocount(df: DataFrame, ids: DataFrame, quantile: float, gene: str = "gene_id", target: str = "target_id", value: str = "value", spread: bool = True) -> DataFrame:
    """(target, pseudo): a quantile over the genes whose id, without its version, is listed."""
    from lociframe.functions.sequence import without_version

    listed = ids.select(without_version(F.col(gene)).alias("__g")).distinct()
    held = df.withColumn("__g", without_version(F.col(gene))).join(listed, "__g", "left_semi")
    return wide(held, [target], value, {"pseudo": quantile}, spread)


def plain_window_score(df: DataFrame, sites: DataFrame, reach: int = 2000, key: str = "key", pos: str = "pos", value: str = "value", site: str = "site") -> DataFrame:
    """(key, site, score): the mean of values within the reach of each site."""
    a = sites.withColumn("__bin", F.explode(F.array(*[F.floor(F.col(site) / reach) + k for k in (-1, 0, 1)])))
    b = df.withColumn("__bin", F.floor(F.col(pos) / reach))
    return a.join(b, [key, "__bin"]).where(F.abs(F.col(pos) - F.col(site)) <= reach).groupBy(key, site).agg(F.avg(value).alias("score"))


def spectrum(df: DataFrame, key: list[str], pos: str, value: str, d: int) -> DataFrame:
    """(key, k, re, im): the first d coefficients of the discrete Fourier transform of each key's rows in order."""
    w = Window.partitionBy(*key)
    numbered = df.withColumns({"__n": F.count("*").over(w), "__i": F.row_number().over(w.orderBy(pos)) - 1})
    laid = numbered.select(*key, F.col(value).alias("__v"), "__n", "__i", F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias("k")).where(F.col("k") <= F.floor(F.col("__n") / 2))
    angle = 2 * F.pi() * F.col("k") * F.col("__i") / F.col("__n")
    return laid.groupBy(*key, "k").agg(F.sum(F.col("__v") * F.cos(angle)).alias("re"), (-F.sum(F.col("__v") * F.sin(angle))).alias("im"))


def tracks(df: DataFrame, keys: list[str], pos: str = "pos", ref: str = "ref", alt: str = "alt") -> DataFrame:
    """(keys, pos, ref, alt, diff): means over targets of both signals, and of their difference."""
    return df.groupBy(*keys, pos).agg(F.avg(ref).alias("ref"), F.avg(alt).alias("alt"), F.avg(F.col(alt) - F.col(ref)).alias("diff"))


def scores_for_lists(scores: DataFrame, lists: DataFrame, snp: str = "snp_id", value: str = "value", stats: list[str] | None = None) -> DataFrame:
    """Merged scores carried back to the variants of each list; of several genes of a variant, the largest."""
    best = scores.groupBy(snp, *(stats or [])).agg(F.max(value).alias(value))
    return lists.join(best, snp)
