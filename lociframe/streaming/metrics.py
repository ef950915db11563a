"""Streaming accuracy: the same mergeable sums as in batch, by target and window of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.operators.metrics import moments, pearson_of, r2_of


def windowed_accuracy(stream: DataFrame, time: str, target: list[str], y: str, p: str, window: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(target, start, end, n, pearsonr, r2) of each tumbling (or sliding) window; rows later than the watermark are
    left out, as in any append query. On a batch table it gives the same rows."""
    held = stream.withWatermark(time, late) if stream.isStreaming else stream
    w = F.window(F.col(time), window, slide) if slide else F.window(F.col(time), window)
    sums = held.groupBy(*target, w.alias("w")).agg(*moments(y, p))
    return sums.select(*target, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", pearson_of().alias("pearsonr"), r2_of().alias("r2"))


def session_sums(stream: DataFrame, time: str, key: list[str], value: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n, total) of sessions that end after a gap."""
    held = stream.withWatermark(time, late) if stream.isStreaming else stream
    done = held.groupBy(*key, F.session_window(F.col(time), gap).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return done.select(*key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")
