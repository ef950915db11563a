"""From alignments to coverage: multi-mapping reads, clips, shifts and GC content."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.checkpoint import cut


def alternative_hits(tag: Column) -> Column:
    """XA hits `chr,+pos,cigar,nm;` as structs of chrom, pos (from 0), strand and cigar."""
    hits = F.filter(F.split(F.coalesce(tag, F.lit("")), ";"), lambda x: F.length(x) > 0)
    return F.transform(hits, lambda x: F.struct(F.split(x, ",")[0].alias("chrom"), (F.abs(F.split(x, ",")[1].cast("bigint")) - 1).alias("pos"), F.when(F.split(x, ",")[1].startswith("-"), "-").otherwise("+").alias("strand"), F.split(x, ",")[2].alias("cigar")))


def mapped(reads: DataFrame, most_hits: int = 10) -> DataFrame:
    """Reads that are mapped, no duplicates, and have at most so many hits; columns mapped, duplicate, n_hits."""
    return reads.where(F.col("mapped") & ~F.col("duplicate") & (F.col("n_hits") <= most_hits))


def weighted_hits(hits: DataFrame, read: str = "read_id") -> DataFrame:
    """hits with weight: one by the number of the read's hits."""
    sizes = hits.groupBy(read).agg((F.lit(1.0) / F.count("*")).alias("weight"))
    return hits.drop("weight").join(sizes, read)


def coverage(hits: DataFrame, chrom: str = "chrom", pos: str = "pos", weight: str = "weight", pseudo: float = 0.01) -> DataFrame:
    return hits.groupBy(chrom, pos).agg((F.sum(weight) + pseudo).alias("coverage"))


def distribute_multi(hits: DataFrame, rounds: int = 4, enough: float = 0.05, read: str = "read_id", chrom: str = "chrom", pos: str = "pos", pseudo: float = 0.01) -> DataFrame:
    """hits with weight: each read's one unit in proportion to the coverage where its hits lie, by expectation and
    maximisation. Rounds end when the mean change of a weight is below enough; each is kept in the shared folder. Reads of
    one hit keep their weight, so only their coverage takes part."""
    first = cut(weighted_hits(hits, read))
    unique = first.where("weight = 1")
    fixed = cut(unique.groupBy(chrom, pos).agg(F.sum("weight").alias("weight")))
    now, total = first.where("weight < 1"), first.count()
    for _ in range(rounds):
        covered = coverage(fixed.unionByName(now.select(chrom, pos, "weight")), chrom, pos, pseudo=pseudo)
        placed = now.join(covered, [chrom, pos])
        totals = placed.groupBy(read).agg(F.sum("coverage").alias("__t"))
        following = cut(placed.join(totals, read).withColumn("__w", F.col("coverage") / F.col("__t")).drop("coverage", "__t"))
        change = (following.agg(F.sum(F.abs(F.col("__w") - F.col("weight")))).first()[0] or 0.0) / max(1, total)
        now = following.withColumn("weight", F.col("__w")).drop("__w")
        if change < enough:
            break
    return unique.unionByName(now.select(*unique.columns))


def tail_threshold(rate: float, p: float = 0.01) -> int:
    """The least k with P(X >= k) <= p for X Poisson; terms are summed from the largest, so the rate may be any."""
    k = math.floor(rate)
    mass = math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate > 0 else 1.0
    tail, term, j = 0.0, mass, k  # P(X >= k)
    while term > 1e-18 and rate > 0:
        tail += term
        j += 1
        term *= rate / j
    if rate <= 0:
        return 1
    while tail > p:  # up
        tail -= mass
        k += 1
        mass *= rate / k
    while k > 0 and tail + mass * k / rate <= p:  # down
        mass *= k / rate
        k -= 1
        tail += mass
    return k


def adaptive_clips(p: float = 0.01, most: int = 64) -> list[tuple[float, int]]:
    """(mean coverage up to, clip): clips grow with the mean they guard."""
    out: list[tuple[float, int]] = []
    for k in range(2, most + 1):
        low, high = 0.0, float(k)
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if tail_threshold(middle, p) <= k else (low, middle)
        out.append((low, k))
    return out


def clipped(value: Column, local_mean: Column, clips: list[tuple[float, int]]) -> Column:
    """At most the clip of the first class whose mean is not below the local one."""
    out = value
    for upto, k in reversed(clips):
        out = F.when(local_mean <= upto, F.least(value, F.lit(float(k)))).otherwise(out)
    return out


def pair_shift(template_length: Column) -> Column:
    """Half the mean template length of proper pairs, rounded."""
    return F.round(F.avg(F.abs(template_length)) / 2).cast("bigint")


def shift_products(forward: DataFrame, reverse: DataFrame, least: int, most: int, key: str = "chrom", pos: str = "pos", n: str = "n") -> DataFrame:
    """(shift, product): for each shift, the product of the strands' coverage summed over positions. Forward rows are
    dealt to the positions that a shift reaches, so the join is an equi-join."""
    a = forward.select(key, F.col(n).alias("__a"), F.col(pos).alias("__p"), F.explode(F.sequence(F.lit(least), F.lit(most))).alias("__d")).select(key, "__a", F.col("__d").cast("bigint").alias("shift"), (F.col("__p") + F.col("__d")).alias("__q"))
    b = reverse.select(key, F.col(n).alias("__b"), F.col(pos).alias("__q"))
    return a.join(b, [key, "__q"]).groupBy("shift").agg(F.sum(F.col("__a") * F.col("__b")).alias("product"))


def best_shift(products: DataFrame) -> DataFrame:
    return products.agg(F.max_by("shift", F.struct("product", -F.col("shift"))).alias("shift"))


def gc_normalised(df: DataFrame, gc: str = "gc", value: str = "coverage", degree: int = 3, ridge: float = 0.01) -> DataFrame:
    """df with normalised: the value by how much its GC content raises coverage, from a ridge regression of log2 coverage
    on powers of GC. Fitted from merged sums, one row whatever the input."""
    import numpy as np

    y = F.log2(F.col(value) + 0.01)
    sums = df.agg(*[F.avg(F.pow(F.col(gc), F.lit(float(k)))).alias(f"m{k}") for k in range(2 * degree + 1)], *[F.avg(F.pow(F.col(gc), F.lit(float(k))) * y).alias(f"y{k}") for k in range(degree + 1)]).first()
    if sums["m0"] is None:
        return df.withColumn("normalised", F.col(value).cast("double"))
    a = np.array([[sums[f"m{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
    a[1:, 1:] += ridge * np.eye(degree)
    b = np.linalg.solve(a, np.array([sums[f"y{i}"] for i in range(degree + 1)]))
    predicted = sum((F.pow(F.col(gc), F.lit(float(k))) * float(b[k]) for k in range(1, degree + 1)), F.lit(float(b[0])))
    return df.withColumn("normalised", F.col(value) / F.pow(F.lit(2.0), predicted - float(sums["y0"])))
