"""Variant effect scores: summaries of reference and alternative signals, percentile grids, and what is built on them.

Scores are long tables (variant, target, stat, value); signals are long tables with a ref and an alt value for each
position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.checkpoint import cut
from lociframe.operators.ordered import running_sums
from lociframe.operators.quantiles import percentiles, wide
from lociframe.operators.signal import hard_clip

LENGTH_STATS = ("SAD", "logSAD", "sqrtSAD", "SAX", "D1", "logD1", "sqrtD1", "D2", "logD2", "sqrtD2", "JS", "logJS", "REF", "ALT")
GENE_STATS = ("SED", "logSED", "D1", "D2", "nD2", "nDi", "JS", "REF", "ALT")


def _known(stats: list[str], known: tuple[str, ...]) -> None:
    if unknown := [s for s in stats if s not in known]:
        raise ValueError(f"unknown statistics {unknown}")


def _entropy(p: Column, q: Column) -> Column:
    """Relative entropy of one position: 0 where p is 0."""
    return F.when(p > 0, p * F.log(p / q)).otherwise(0.0)


def _both_ways(a: str, b: str) -> Column:
    return (F.sum(_entropy(F.col(a), F.col(b))) + F.sum(_entropy(F.col(b), F.col(a)))) / 2


def _shares(df: DataFrame, keys: list[str], forms: dict[str, tuple[Column, Column]], pseudo: str | None) -> DataFrame:
    """df with, for each form, both signals plus a pseudocount as shares of their sums: n_ref and n_alt. The pseudocount
    is a column, or the 25th percentile of the reference."""
    base = df.withColumns({f"{n}{s}": c for n, pair in forms.items() for s, c in zip(("_ref", "_alt"), pair)})
    level = [F.percentile(f"{n}_ref", F.lit(0.25)).alias(f"{n}_p") for n in forms] if pseudo is None else [F.first(pseudo).alias(f"{n}_p") for n in forms]
    sums = base.groupBy(*keys).agg(*level, F.count("*").alias("__n"), *[F.sum(f"{n}{s}").alias(f"{n}{s}_sum") for n in forms for s in ("_ref", "_alt")])
    joined = base.join(sums, keys)
    return joined.withColumns({f"{n}{s}": (F.col(f"{n}{s}") + F.col(f"{n}_p")) / (F.col(f"{n}{s}_sum") + F.col("__n") * F.col(f"{n}_p")) for n in forms for s in ("_ref", "_alt")})


def effect_scores(df: DataFrame, keys: list[str], ref: str = "ref", alt: str = "alt", pos: str = "pos", stats: list[str] = list(LENGTH_STATS)) -> DataFrame:
    """One row for each key with a column for each statistic, over all positions. The largest difference keeps its sign;
    of equals the first position's."""
    _known(stats, LENGTH_STATS)
    r, a = F.col(ref).cast("double"), F.col(alt).cast("double")
    d, dl, ds = a - r, F.log2(a + 1) - F.log2(r + 1), F.sqrt(a) - F.sqrt(r)
    plain = {
        "SAD": hard_clip(F.sum(a) - F.sum(r)), "logSAD": hard_clip(F.sum(dl)), "sqrtSAD": hard_clip(F.sum(ds)),
        "SAX": F.max_by(d, F.struct(F.abs(d), -F.col(pos))),
        "D1": hard_clip(F.sum(F.abs(d))), "logD1": hard_clip(F.sum(F.abs(dl))), "sqrtD1": hard_clip(F.sum(F.abs(ds))),
        "D2": hard_clip(F.sqrt(F.sum(d * d))), "logD2": hard_clip(F.sqrt(F.sum(dl * dl))), "sqrtD2": hard_clip(F.sqrt(F.sum(ds * ds))),
        "REF": F.sum(r), "ALT": F.sum(a),
    }
    out = df.groupBy(*keys).agg(*[plain[s].alias(s) for s in stats if s in plain] or [F.count("*").alias("__rows")])
    forms = {n: f for s, n, f in (("JS", "js", (r, a)), ("logJS", "ljs", (F.log2(r + 1), F.log2(a + 1)))) if s in stats}
    if forms:
        shares = _shares(df, keys, forms, None).groupBy(*keys).agg(*[_both_ways(f"{n}_ref", f"{n}_alt").alias({"js": "JS", "ljs": "logJS"}[n]) for n in forms])
        out = out.join(shares, keys)
    return out.select(*keys, *stats)


def gene_scores(df: DataFrame, keys: list[str], ref: str = "ref", alt: str = "alt", pseudo: str = "pseudo", stats: list[str] = list(GENE_STATS)) -> DataFrame:
    """The same over the bins of a gene, with a pseudocount column for shares."""
    _known(stats, GENE_STATS)
    r, a = F.col(ref).cast("double"), F.col(alt).cast("double")
    d = a - r
    shares = _shares(df, keys, {"x": (r, a)}, pseudo)
    apart = F.col("x_alt") - F.col("x_ref")
    made = {
        "SED": hard_clip(F.sum(a) - F.sum(r)), "logSED": F.log2(F.sum(a) + 1) - F.log2(F.sum(r) + 1), "D1": hard_clip(F.sum(F.abs(d))),
        "D2": hard_clip(F.sqrt(F.sum(d * d))), "nD2": F.sqrt(F.sum(apart * apart)), "nDi": F.max(F.abs(apart)), "JS": _both_ways("x_ref", "x_alt"), "REF": F.sum(r), "ALT": F.sum(a),
    }
    return shares.groupBy(*keys).agg(*[made[s].alias(s) for s in stats])


def ratio_scores(df: DataFrame, keys: list[str], ref: str = "ref", alt: str = "alt", pseudo: float = 1.0) -> DataFrame:
    """SED, SEDR (log ratio of sums) and SER (sum of log ratios) with REF and ALT."""
    r, a = F.col(ref).cast("double"), F.col(alt).cast("double")
    return df.groupBy(*keys).agg((F.sum(a) - F.sum(r)).alias("SED"), (F.log2(F.sum(a) + pseudo) - F.log2(F.sum(r) + pseudo)).alias("SEDR"), F.sum(F.log2(a + pseudo) - F.log2(r + pseudo)).alias("SER"), F.sum(r).alias("REF"), F.sum(a).alias("ALT"))


def coverage_ratio(df: DataFrame, keys: list[str], pos: str = "pos", ref: str = "ref", alt: str = "alt", pseudo: float = 1.0, least: float = 0.0) -> DataFrame:
    """(keys, COVR, SCOVR): of all splits of the alt/ref ratios, with a one added at both ends, the largest absolute log
    ratio of the mean after to the mean before, and the same with its sign. Positions whose reference is not above least
    are left out, unless all are."""
    kept = df.withColumn("__any", F.max(F.col(ref)).over(Window.partitionBy(*keys)) > least).where(~F.col("__any") | (F.col(ref) > least))
    ratio = (F.col(alt) + pseudo) / (F.col(ref) + pseudo)
    w = Window.partitionBy(*keys).orderBy(pos)
    sums = kept.withColumn("__x", ratio).withColumns({"__up": F.sum("__x").over(w.rowsBetween(Window.unboundedPreceding, 0)), "__k": F.row_number().over(w), "__n": F.count("*").over(Window.partitionBy(*keys)), "__t": F.sum("__x").over(Window.partitionBy(*keys))})
    first = F.when(F.col("__k") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    splits = sums.select(*keys, "__up", "__k", "__n", "__t", "__x", F.explode(first).alias("__i"))
    up = F.when(F.col("__i") == 0, F.lit(1.0)).otherwise((F.col("__up") + 1) / (F.col("__k") + 1))
    down = F.when(F.col("__i") == 0, (F.col("__t") + 1) / (F.col("__n") + 1)).otherwise((F.col("__t") - F.col("__up") + 1) / (F.col("__n") - F.col("__k") + 1))
    scored = splits.withColumn("__s", F.log2(down / up)).withColumn("__at", F.col("__k") - 1 + F.col("__i"))
    return scored.groupBy(*keys).agg(F.max(F.abs("__s")).alias("COVR"), F.max_by("__s", F.struct(F.round(F.abs("__s"), 9), -F.col("__at"))).alias("SCOVR"))


def proportion_shift(df: DataFrame, keys: list[str], is_distal: Column, ref: str = "ref", alt: str = "alt", pseudo: float = 1.0) -> DataFrame:
    """Log odds of the distal part, alternative against reference."""
    total = lambda v, x: F.sum(F.when(x, F.col(v)).otherwise(0.0)) + pseudo
    odds = lambda v: F.log2(total(v, is_distal) / total(v, ~is_distal))
    return df.groupBy(*keys).agg((odds(alt) - odds(ref)).alias("shift"))


def centred_by_nucleotide(df: DataFrame, group: list[str], value: str = "value") -> DataFrame:
    """Saturation scores less their mean over the nucleotides of a position."""
    return df.withColumn(value, F.col(value) - F.avg(value).over(Window.partitionBy(*group)))


def map_difference(df: DataFrame, keys: list[str], ref: str = "ref", alt: str = "alt") -> DataFrame:
    """SCD: norm of the difference of two maps; SSD: difference of their norms."""
    r, a = F.col(ref), F.col(alt)
    return df.groupBy(*keys).agg(F.sqrt(F.sum((a - r) * (a - r))).alias("SCD"), (F.sqrt(F.sum(a * a)) - F.sqrt(F.sum(r * r))).alias("SSD"))


def grid() -> list[float]:
    """The percentiles of the grid: steps of 0.001 in both tenths at the ends, of 0.01 between."""
    return [k / 1000 for k in range(1, 100)] + [k / 100 for k in range(10, 90)] + [k / 1000 for k in range(900, 1000)]


def percentile_grid(df: DataFrame, target: list[str], value: str = "value", spread: bool = True) -> DataFrame:
    """(target, k, percentile, value): the grid over all rows of each target, by interpolation."""
    return percentiles(df, target, value, grid(), spread)


def percentile_of(scores: DataFrame, grids: DataFrame, target: list[str], value: str = "value", spread: bool = True) -> DataFrame:
    """scores with the percentile where the value would be inserted on the left, at most the last: distinct values and grid
    points are ordered together once and the points below each are counted. A null has none."""
    grids = cut(grids)  # asked for several times; a few hundred rows for each target
    points = grids.select(*target, F.col("value").alias(value), F.lit(1).alias("__g"))
    asked = scores.where(F.col(value).isNotNull()).select(*target, value).distinct().withColumn("__g", F.lit(0))
    counted = points.unionByName(asked).groupBy(*target, value).agg(F.sum("__g").alias("__g"))
    below = running_sums(counted, target, value, {"__upto": "__g"}, spread).select(*target, value, (F.col("__upto") - F.col("__g")).alias("__below"))
    last = grids.groupBy(*target).agg(F.max("k").alias("__last"))
    ranks = below.join(last, target).select(*target, value, F.least("__below", "__last").alias("k"))
    found = ranks.join(grids.select(*target, "k", "percentile"), [*target, "k"]).drop("k")
    return scores.join(found, [*target, value], "left")


def fit_cauchy(df: DataFrame, target: list[str], value: str = "value", spread: bool = True) -> DataFrame:
    """(target, loc, scale): median, and half the distance of the quartiles, over all rows."""
    q = wide(df, target, value, {"__a": 0.25, "loc": 0.5, "__c": 0.75}, spread)
    return q.select(*target, "loc", ((F.col("__c") - F.col("__a")) / 2).alias("scale"))


def target_set(label: Column, names: list[str]) -> Column:
    """The last of the names that the label starts with, else -."""
    out = F.lit("-")
    for n in names:
        out = F.when(label.startswith(n), n).otherwise(out)
    return out


def normalised_cauchy(scores: DataFrame, fits: DataFrame, target: list[str], group: str, value: str = "value") -> DataFrame:
    """scores with their value carried from the target's Cauchy distribution to that of its group's median parameters."""
    medians = fits.groupBy(group).agg(F.percentile("loc", F.lit(0.5)).alias("gl"), F.percentile("scale", F.lit(0.5)).alias("gs"))
    joined = scores.join(fits.join(medians, group), target)
    q = 0.5 + F.atan((F.col(value) - F.col("loc")) / F.col("scale")) / F.pi()
    q = F.when(q > 0.5, q - 1e-5).otherwise(q + 1e-5)
    return joined.withColumn("normalised", F.col("gl") + F.col("gs") * F.tan(F.pi() * (q - 0.5))).drop("loc", "scale", "gl", "gs")


def ensemble(parts: list[DataFrame], keys: list[str], value: str = "value") -> DataFrame:
    """Mean of replicate scores."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*keys).agg(F.avg(value).alias(value))


def ld_weighted(ld: DataFrame, scores: DataFrame, snp: str = "snp_id", partner: str = "partner", r: str = "r", target: str = "target_id", value: str = "value") -> DataFrame:
    """(snp, target, score): over its partners, the sum of r times their score."""
    other = scores.withColumnRenamed(snp, partner)
    return ld.join(other, partner).groupBy(snp, target).agg(F.sum(F.col(r) * F.col(value)).alias("score"))


def strand_collapsed(df: DataFrame, pairs: DataFrame, keys: list[str], target: str = "target_id", merged: str = "merged_id", value: str = "value") -> DataFrame:
    """Stranded targets summed into the merged ones that pairs (target, merged) name."""
    return df.join(pairs, target).groupBy(*keys, merged).agg(F.sum(value).alias(value))


def merged_targets(targets: DataFrame, index: str = "target_id", pair: str = "strand_pair") -> DataFrame:
    """(target, merged): of each strand pair the smaller index stands for both; without a pair, itself."""
    return targets.select(index, F.least(F.col(index), F.coalesce(F.col(pair), F.col(index))).alias("merged_id"))


def exon_gene_ratio(exons: DataFrame, genes: DataFrame, gene: str = "gene_id", target: str = "target_id", value: str = "value", spread: bool = True) -> DataFrame:
    """exons with the ratio of their value to their gene's, which has a pseudocount: the median over targets of the 25th
    percentile."""
    pseudo = wide(genes, [target], value, {"q": 0.25}, spread).agg(F.percentile("q", F.lit(0.5)).alias("__p"))  # of one row for each target
    g = genes.select(gene, target, F.col(value).alias("__g"))
    return exons.join(g, [gene, target]).crossJoin(F.broadcast(pseudo)).withColumn("ratio", F.col(value) / (F.col("__g") + F.col("__p"))).drop("__g", "__p")


def within_group_log_pearson(df: DataFrame, group: list[str], y: str, p: str, least: float = 1e-6) -> DataFrame:
    """Correlation of log2(x + 1) within each group; null where either varies too little."""
    from lociframe.operators.metrics import moments, pearson_of

    logs = df.withColumns({"__y": F.log2(F.col(y) + 1), "__p": F.log2(F.col(p) + 1)})
    sums = logs.groupBy(*group).agg(*moments("__y", "__p"), F.var_pop("__y").alias("vy"), F.var_pop("__p").alias("vp"))
    return sums.select(*group, F.when((F.col("vy") > least) & (F.col("vp") > least), pearson_of()).alias("pearsonr"))
