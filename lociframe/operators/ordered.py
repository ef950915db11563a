"""Ranks and running sums, also for keys too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.checkpoint import cut


def met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with what right, which has one row for each key, has for its keys; a null is a key like any other."""
    renamed = {k: f"__key{i}" for i, k in enumerate(keys)}
    same = F.lit(True)
    for k, n in renamed.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    return left.join(right.withColumnsRenamed(renamed), same).drop(*renamed.values())


def running_sums(df: DataFrame, key: list[str], order: str, sums: dict[str, str], spread: bool = False) -> DataFrame:
    """df with, for each name: column of sums, the running sum of the column by the order within the key; rows that tie
    share the sum that includes them all. spread: rows are dealt by ranges of (key, order), so that a key may span any
    number of tasks; only the totals of its ranges meet in one."""
    if not spread:
        w = Window.partitionBy(*key).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: F.sum(c).over(w) for n, c in sums.items()})
    dealt = cut(df.repartitionByRange(*key, order).withColumn("__part", F.spark_partition_id()))
    totals = dealt.groupBy(*key, "__part").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    w = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*key, "__part", *[F.coalesce(F.sum(f"__{n}").over(w), F.lit(0)).alias(f"__{n}") for n in sums])
    w = Window.partitionBy(*key, "__part").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    within = dealt.withColumns({n: F.sum(c).over(w) for n, c in sums.items()})
    return met(within, before, [*key, "__part"]).withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).drop("__part", *[f"__{n}" for n in sums])


def mid_ranks(df: DataFrame, key: list[str], value: str, spread: bool = False) -> DataFrame:
    """(key, value, n, rank): each distinct value with its rows and their average rank from 1. Rows are counted by value
    before anything is ordered."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("n"))
    done = running_sums(counted, key, value, {"__upto": "n"}, spread)
    return done.withColumn("rank", F.col("__upto") - (F.col("n") - 1) / 2).drop("__upto")


def numbered(df: DataFrame, key: list[str], order: list[str], out: str, spread: bool = False) -> DataFrame:
    """df with how many rows of its key come before each, by an order without ties; with spread over any number of tasks."""
    return running(dealt(df, key, order[0], spread), key, order, {out: ("sum", F.lit(1))}, spread).drop("__part")


def dealt(df: DataFrame, key: list[str], order: str, spread: bool) -> DataFrame:
    """df with __part: where spread, the number of the range of (key, order) that a row is in, kept in the shared folder
    so that it stays; else 0. Rows that tie in the order share a part."""
    if not spread:
        return df.withColumn("__part", F.lit(0))
    return cut(df.repartitionByRange(*key, order).withColumn("__part", F.spark_partition_id()))


def running(df: DataFrame, key: list[str], order: list[str], what: dict[str, tuple[str, Column]], spread: bool) -> DataFrame:
    """Of a dealt table: for each name the sum or max of a column over the rows before, its last value (the row before),
    or its next (the row after). What crosses parts is one row for each part of a key."""
    parts = [*key, "__part"]
    w = Window.partitionBy(*parts).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    within = {
        n: {"sum": lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)), "max": lambda c: F.max(c).over(before), "last": lambda c: F.lag(c).over(w), "next": lambda c: F.lead(c).over(w)}[kind](c)
        for n, (kind, c) in what.items()
    }
    if not spread:
        return df.withColumns(within)
    at = F.struct(*order)
    totals = df.groupBy(*parts).agg(*[{"sum": F.sum(c), "max": F.max(c), "last": F.max_by(c, at), "next": F.min_by(c, at)}[kind].alias(f"__{n}") for n, (kind, c) in what.items()])
    p = Window.partitionBy(*key).orderBy("__part")
    past, future = p.rowsBetween(Window.unboundedPreceding, -1), p.rowsBetween(1, Window.unboundedFollowing)
    carried = {
        n: {"sum": lambda c: F.coalesce(F.sum(c).over(past), F.lit(0)), "max": lambda c: F.max(c).over(past), "last": lambda c: F.last(c, True).over(past), "next": lambda c: F.first(c, True).over(future)}[kind](F.col(f"__{n}"))
        for n, (kind, _) in what.items()
    }
    carry = totals.select(*parts, *[c.alias(f"__{n}") for n, c in carried.items()])
    joined = met(df.withColumns(within), carry, parts)
    mixed = {"sum": lambda a, b: a + b, "max": lambda a, b: F.greatest(a, b), "last": lambda a, b: F.coalesce(a, b), "next": lambda a, b: F.coalesce(a, b)}
    return joined.withColumns({n: mixed[kind](F.col(n), F.col(f"__{n}")) for n, (kind, _) in what.items()}).drop(*[f"__{n}" for n in what])
