"""Splits without leakage, samples, shards, and the report of what leaks."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.operators.intervals import overlap_join
from lociframe.operators.ordered import dealt, numbered, running


def by_key(key: Column, test: list, valid: list) -> Column:
    """test, valid or train by lists of keys; test wins."""
    return F.when(key.isin(*test), "test").when(key.isin(*valid), "valid").otherwise("train")


def hashed(key: Column, test: float, valid: float, seed: int = 44) -> Column:
    """The same by shares, by a hash of the key and the seed: a cluster's key keeps its members together."""
    u = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return F.when(u < test, "test").when(u < test + valid, "valid").otherwise("train")


def folds(key: Column, n: int) -> Column:
    """A fold by plain arithmetic on a whole number."""
    return F.concat(F.lit("fold"), F.pmod(key * 2654435761 % 4294967296, F.lit(n)).cast("string"))


def quota_split(df: DataFrame, shares: dict[str, float], size: str = "size", id: str = "id", abstain: float = 0.2, seed: int = 44, most: int = 1_000_000) -> DataFrame:
    """df with split: the largest first, each goes to a part drawn in proportion to what it lacks of its quota, among
    those whose lack it does not exceed too much (abstain: the share of the lack that it may take); else to the fullest.
    The draw is sequential by nature, so it is done on the driver over one small row for each contig, at most so many."""
    rows = df.select(id, size).orderBy(F.desc(size), id).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} contigs; use hashed()")
    total = sum(r[size] for r in rows)
    left = {k: s * total for k, s in shares.items()}
    main, draw, chosen = max(shares, key=lambda k: shares[k]), random.Random(seed), []
    for r in rows:
        fits = {k: x for k, x in left.items() if x > 0 and (k == main or r[size] <= abstain * x)} or {main: 1.0}
        part = draw.choices(list(fits), list(fits.values()))[0]
        left[part] -= r[size]
        chosen.append((r[id], part))
    spark = df.sparkSession
    return df.join(spark.createDataFrame(chosen, f"{id} {df.schema[id].dataType.simpleString()}, split string"), id)


def fold_split(df: DataFrame, n: int, size: str = "size", id: str = "id", seed: int = 44) -> DataFrame:
    """The same into n equal folds."""
    return quota_split(df, {f"fold{k}": 1 / n for k in range(n)}, size, id, 1.0, seed)


def leakage(pairs: DataFrame, segments: DataFrame, a: tuple[str, str, str] = ("a_key", "a_start", "a_end"), b: tuple[str, str, str] = ("b_key", "b_start", "b_end"), id: str = "id", width: int = 256) -> DataFrame:
    """(a_split, b_split, pairs, bases): aligned pairs by the split that each side shares most positions with (train
    before valid before test), for those whose both sides have one. segments: key, start, end, split."""

    def side(which: tuple[str, str, str], name: str) -> DataFrame:
        left = pairs.select(id, F.col(which[0]).alias("key"), F.col(which[1]).alias("a_start"), F.col(which[2]).alias("a_end"))
        right = segments.select("key", F.col("start").alias("b_start"), F.col("end").alias("b_end"), "split")
        met = overlap_join(left, right, width=width).groupBy(id, "split").agg(F.sum("overlap").alias("bp"))
        order = F.when(F.col("split") == "train", 3).when(F.col("split") == "valid", 2).otherwise(1)
        return met.groupBy(id).agg(F.max_by("split", F.struct("bp", order)).alias(name))

    size = pairs.select(id, (F.col(a[2]) - F.col(a[1])).alias("bp"))
    return side(a, "a_split").join(side(b, "b_split"), id).join(size, id).groupBy("a_split", "b_split").agg(F.count("*").alias("pairs"), F.sum("bp").alias("bases"))


def sampled(df: DataFrame, share: float, order: Column, group: list[str] | None = None, spread: bool = True) -> DataFrame:
    """floor(n * share) rows (of each group), those of the smallest order, which has no ties. spread: a group's ranks are
    taken over any number of tasks."""
    group = group or []
    sizes = df.groupBy(*group).agg(F.floor(F.count("*") * share).alias("__most"))
    ranked = numbered(df.withColumn("__o", order), group, ["__o"], "__k", spread).drop("__o")
    joined = ranked.join(sizes, group) if group else ranked.crossJoin(F.broadcast(sizes))  # one row
    return joined.where(F.col("__k") < F.col("__most")).drop("__k", "__most")


def within_budget(df: DataFrame, budget: int, group: str, order: list[Column]) -> DataFrame:
    """The groups, in this order, whose rows so far do not reach the budget before them."""
    sizes = df.groupBy(group).agg(F.count("*").alias("__n"))
    w = Window.orderBy(*order)  # one row for each group
    kept = sizes.withColumn("__before", F.sum("__n").over(w) - F.col("__n")).where(F.col("__before") < budget)
    return df.join(kept.select(group), group)


def near_top(df: DataFrame, group: list[str], value: str, share: float = 0.666) -> DataFrame:
    """Rows of at least the share of their group's largest value."""
    most = df.groupBy(*group).agg(F.max(value).alias("__m"))
    return df.join(most, group).where(F.col(value) >= share * F.col("__m")).drop("__m")


def top_share(df: DataFrame, group: list[str], value: str, share: float, id: str) -> DataFrame:
    """The share of rows of each group with the largest values, one at least."""
    sizes = df.groupBy(*group).agg(F.greatest(F.floor(F.count("*") * share), F.lit(1)).alias("__most"))
    ranked = df.withColumn("__k", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(value), id)))
    return ranked.join(sizes, group).where(F.col("__k") <= F.col("__most")).drop("__k", "__most")


def shards(df: DataFrame, label: str, order: list[str], size: int = 256, spread: bool = True) -> DataFrame:
    """df with shard: runs of so many rows within each label, by an order without ties; none is empty."""
    made = numbered(df.withColumn("__o", F.struct(*order)), [label], ["__o"], "__k", spread)
    return made.withColumn("shard", F.floor(F.col("__k") / size)).drop("__o", "__k")


def at_least(df: DataFrame, length: int, start: str = "start", end: str = "end") -> DataFrame:
    """Intervals, contigs or exons, of at least so many positions."""
    return df.where(F.col(end) - F.col(start) >= length)


def contiguous_tail(df: DataFrame, group: str, number: str) -> DataFrame:
    """Per group from the highest number on, the rows whose numbers go down by exactly one."""
    w = Window.partitionBy(group)
    ranked = df.withColumn("__k", F.row_number().over(w.orderBy(F.desc(number)))).withColumn("__m", F.max(number).over(w))
    return ranked.where(F.col(number) + F.col("__k") == F.col("__m") + 1).drop("__k", "__m")


def inner_members(df: DataFrame, group: str, order: list[str], ends: int) -> DataFrame:
    """Rows that are not among the first or last so many of their group."""
    w = Window.partitionBy(group)
    ranked = df.withColumns({"__a": F.row_number().over(w.orderBy(*order)), "__b": F.count("*").over(w)})
    return ranked.where((F.col("__a") > ends) & (F.col("__a") <= F.col("__b") - ends)).drop("__a", "__b")


def assert_sorted(df: DataFrame, number: str, key: str, pos: str) -> DataFrame:
    """df; an error where, in the order of the row numbers, positions fall within a key or a key comes again."""
    last = running(dealt(df, [], number, True), [], [number], {"__b": ("last", F.struct(F.col(key).alias("k"), F.col(pos).alias("p")))}, True)
    fresh = last.withColumn("__new", F.when(F.col("__b.k").eqNullSafe(F.col(key)), 0).otherwise(1)).drop("__part")
    runs = fresh.groupBy(F.col(key).alias("__key")).agg(F.sum("__new").alias("__runs"))
    bad = (F.col("__b.k").eqNullSafe(F.col(key)) & (F.col("__b.p") > F.col(pos))) | (F.col("__runs") > 1)
    error = F.raise_error(F.lit("the rows are not sorted")).cast(df.schema[pos].dataType)
    again = fresh.join(runs, F.col(key).eqNullSafe(F.col("__key")), "left")
    return again.withColumn(pos, F.when(F.coalesce(bad, F.lit(False)), error).otherwise(F.col(pos))).select(*df.columns)
