"""The registry of queries and of the independent SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.session import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Common table expressions that queries' SQL may start from; {name} in a query's SQL stands for one.
VIEWS = {
    "iv": "SELECT l_suppkey AS key, CAST(CAST(l_shipdate AS DATE) - DATE '1992-01-01' AS BIGINT) AS s, CAST(CAST(l_shipdate AS DATE) - DATE '1992-01-01' AS BIGINT) + CAST(floor(l_quantity) AS BIGINT) AS e, l_orderkey AS okey, CAST(l_linenumber AS BIGINT) AS line, l_extendedprice AS v FROM lineitem",
    "vr": "SELECT c_custkey AS k, 'chr' || (c_nationkey % 5 + 1) AS chrom, CAST(1000 + (c_custkey * 7919) % 50021 AS BIGINT) AS pos, CASE WHEN c_custkey % 4 = 0 THEN 'chr' || (c_nationkey % 5 + 1) || ':' || CAST(1000 + (c_custkey * 7919) % 50021 AS BIGINT) ELSE 'rs' || c_custkey END AS snp_id, substr('ACGT', CAST(c_custkey % 4 AS INTEGER) + 1, 1) AS ref, substr('CGTA', CAST(c_custkey % 4 AS INTEGER) + 1, 1) || CASE WHEN c_custkey % 5 = 0 THEN ',' || substr('GTAC', CAST(c_custkey % 4 AS INTEGER) + 1, 1) || 'AC' ELSE '' END AS alts FROM customer",
    "pt": "SELECT user_id AS key, CAST(date_diff('second', TIMESTAMP '2024-01-01', ts) AS BIGINT) AS pos, event_id AS id, event_type AS kind, value AS v FROM events",
}


def query(sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL for the same rows where there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in views.split())
            text = sql.strip()
            if head:
                text = f"WITH RECURSIVE {head}, {text[text.index(' ') + 1 :].removeprefix('RECURSIVE ')}" if text.upper().startswith("WITH") else f"WITH {head} {text}"
            ORACLES[f.__name__] = text
        return f

    return add


def intervals(spark: SparkSession, sf_dir: str, key: str = "l_suppkey") -> DataFrame:
    """lineitem as intervals of days, by supplier as a rule: key, s, e, okey, line, v."""
    start = F.expr("cast(datediff(l_shipdate, DATE'1992-01-01') as bigint)")
    return table(spark, sf_dir, "lineitem").select(
        F.col(key).alias("key"), start.alias("s"), (start + F.floor("l_quantity").cast("bigint")).alias("e"), F.col("l_orderkey").alias("okey"), F.col("l_linenumber").cast("bigint").alias("line"), F.col("l_extendedprice").alias("v")
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as seconds of a user: key, pos, id, kind, v."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)").alias("pos"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("value").alias("v"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers as variants: k, chrom, pos, id, ref and alts, as they would stand in a file."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    letter = lambda letters: F.substring(F.lit(letters), (k % 4 + 1).cast("int"), F.lit(1))
    alts = F.concat(letter("CGTA"), F.when(k % 5 == 0, F.concat(F.lit(","), letter("GTAC"), F.lit("AC"))).otherwise(""))
    chrom = F.concat(F.lit("chr"), (F.col("c_nationkey") % 5 + 1).cast("string"))
    return c.select(k.alias("k"), chrom.alias("chrom"), (1000 + (k * 7919) % 50021).alias("pos"), F.when(k % 4 == 0, ".").otherwise(F.concat(F.lit("rs"), k.cast("string"))).alias("id"), letter("ACGT").alias("ref"), alts.alias("alts"))


for _module in ("interval_queries", "signal_queries", "metric_queries", "score_queries", "sequence_queries", "split_queries", "gene_queries", "reader_queries", "variant_queries", "map_queries", "spread_queries"):
    import_module(f"lociframe.plans.{_module}")
