"""Batch inference with a model that the caller brings, and what is done around it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.functions.sequence import reverse_complement, shifted

Predict = Callable[[list[str]], "list[list[list[float]]]"]


def predict(df: DataFrame, load: Callable[[], Predict], keys: list[str], seq: str = "seq", batch: int = 32) -> DataFrame:
    """(keys, bin, target_id, value): load() gives, once for each task, a function from sequences to arrays of bins by
    targets. Filters belong before this step, as nothing is pushed through it."""
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                rows = []
                for key, made in zip(part[keys].itertuples(index=False, name=None), model(part[seq].tolist()), strict=True):
                    rows += [(*key, b, t, float(v)) for b, targets in enumerate(made) for t, v in enumerate(targets)]
                yield pd.DataFrame(rows, columns=[*keys, "bin", "target_id", "value"])

    return df.select(*keys, seq).mapInPandas(over, f"{fields}, bin int, target_id int, value double")


def augmented(df: DataFrame, seq: str = "seq", complement: bool = True, shifts: list[int] | None = None) -> DataFrame:
    """df with every shift, forward and as reverse complement: columns shift and reversed."""
    shifts = shifts or [0]
    forms = [F.struct(shifted(F.col(seq), s).alias("s"), F.lit(s).alias("shift"), F.lit(False).alias("reversed")) for s in shifts]
    if complement:
        forms += [F.struct(reverse_complement(shifted(F.col(seq), s)).alias("s"), F.lit(s).alias("shift"), F.lit(True).alias("reversed")) for s in shifts]
    return df.withColumn("__f", F.explode(F.array(*forms))).withColumns({seq: F.col("__f.s"), "shift": F.col("__f.shift"), "reversed": F.col("__f.reversed")}).drop("__f")


def restored(df: DataFrame, bins: int, pairs: DataFrame | None = None) -> DataFrame:
    """Predictions of reversed sequences turned back: bins in reverse, and where pairs (target_id, strand_pair) are given,
    the paired target."""
    out = df.withColumn("bin", F.when(F.col("reversed"), bins - 1 - F.col("bin")).otherwise(F.col("bin")))
    if pairs is not None:
        out = out.join(pairs, "target_id", "left").withColumn("target_id", F.when(F.col("reversed"), F.coalesce("strand_pair", "target_id")).otherwise(F.col("target_id"))).drop("strand_pair")
    return out


def ensembled(df: DataFrame, keys: list[str]) -> DataFrame:
    """The mean over augmentations."""
    return df.groupBy(*keys, "bin", "target_id").agg(F.avg("value").alias("value"))


def targets_summed(df: DataFrame, keys: list[str], kept: Column | None = None) -> DataFrame:
    """The kept targets summed for each bin."""
    return (df if kept is None else df.where(kept)).groupBy(*keys, "bin").agg(F.sum("value").alias("value"))


def length_summed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys, "target_id").agg(F.sum("value").alias("value"))


def stepped(df: DataFrame, step: int) -> DataFrame:
    """Every step-th bin."""
    return df.where(F.col("bin") % step == 0)
