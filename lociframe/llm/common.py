"""Small helpers that the text operators share."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.checkpoint import cut, fresh_dir, shared_dir

__all__ = ["BLANKS", "LOWER", "UPPER", "ascii_lower", "cut", "fields", "fresh_dir", "literal_table", "own_prefix", "shared_dir", "small_batches"]

#: The characters of [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"

#: The letters that are lower-cased where only A-Z count.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch, as whole texts may be long; a smaller setting of the caller stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z, everything else untouched."""
    return F.translate(column, UPPER, LOWER)


def own_prefix(*tables: DataFrame) -> str:
    """What the names of an operator's own columns begin with: none of these tables has a column that does."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for t in tables for c in t.columns):
        prefix += "_"
    return prefix


def literal_table(spark: SparkSession, parts: list[list[dict]], schema: str) -> DataFrame:
    """Rows that the driver made, as a table: one part travels with the query, several go through the shared folder, one
    at a time."""

    def table(part: list[dict]) -> DataFrame:
        return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(part)), f"array<struct<{schema}>>")).alias("p")).select("p.*")

    if len(parts) == 1:
        return table(parts[0])
    out = fresh_dir(spark, "rows")
    for part in parts:
        table(part).coalesce(1).write.mode("append").parquet(out)
    return spark.read.parquet(out)


def fields(df: DataFrame, *names: str) -> DataFrame:
    """Exactly these columns, whatever else the table has."""
    return df.select(*[F.col(f"`{n}`") for n in names])
