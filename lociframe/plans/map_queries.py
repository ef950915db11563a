"""Contact maps on the driver's tables: hours of a user's day against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.operators import contacts as ct
from lociframe.plans.catalogue import points, query

#: A map for every tenth user: events of one hour times those of another, and a little more above the diagonal.
_M = "h AS (SELECT key, pos // 3600 % 24 AS i, CAST(count(*) AS DOUBLE) AS v FROM pt WHERE key % 5 = 0 GROUP BY ALL), m AS (SELECT a.key, a.i, b.i AS j, a.v * b.v + CASE WHEN a.i < b.i THEN a.i * 0.5 ELSE 0 END AS value FROM h a JOIN h b ON b.key = a.key)"


def _map(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = points(spark, sf_dir).where("key % 5 = 0").groupBy("key", (F.floor(F.col("pos") / 3600) % 24).alias("i")).agg(F.count("*").cast("double").alias("v"))
    square = ct.outer(h, ["key"], "i", "v")
    return square.select("key", "i", "j", (F.col("dot") + F.when(F.col("i") < F.col("j"), F.col("i") * 0.5).otherwise(0.0)).alias("value"))


def _r(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select("key", "i", "j", F.round("value", places).alias("value"))


@query(f"WITH {_M} SELECT a.key, a.i, a.j, round((a.value + b.value) / 2, 6) AS value FROM m a JOIN m b ON b.key = a.key AND b.i = a.j AND b.j = a.i", "pt")
def symmetric_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(ct.symmetric(_map(spark, sf_dir), ["key"]))


@query(f"WITH {_M} SELECT key, i, j, round(value, 6) AS value FROM m WHERE i <= j UNION ALL SELECT key, j, i, round(value, 6) FROM m WHERE i < j", "pt")
def filled_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(ct.filled(_map(spark, sf_dir).where("i <= j"), ["key"]))


@query(f"WITH {_M}, t AS (SELECT key, abs(i - j) AS d, quantile_cont(value, 0.5) * 1.5 AS t FROM m GROUP BY ALL) SELECT m.key, i, j, round(least(value, t), 6) AS value FROM m JOIN t ON t.key = m.key AND t.d = abs(i - j)", "pt")
def clipped_by_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(ct.clipped_by_diagonal(_map(spark, sf_dir), ["key"], times=1.5, spread=True))


@query(f"WITH {_M} SELECT key, i // 3 AS i, j // 3 AS j, round(avg(value), 6) AS value FROM m GROUP BY ALL", "pt")
def coarsened_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(ct.coarsened(_map(spark, sf_dir), ["key"], 3))


@query(f"WITH {_M}, w AS (SELECT a.key, a.i, a.j, exp(-0.5 * pow((a.i - b.i) / 0.7, 2)) * exp(-0.5 * pow((a.j - b.j) / 0.7, 2)) AS w, b.value FROM m a JOIN m b ON b.key = a.key AND abs(a.i - b.i) <= 3 AND abs(a.j - b.j) <= 3) SELECT key, i, j, round(sum(w * value) / sum(w), 5) AS value FROM w GROUP BY ALL", "pt")
def blurred_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(ct.blurred(_map(spark, sf_dir), ["key"], 0.7), 5)


@query(f"WITH {_M} SELECT key, i - 3 AS i, j - 3 AS j, round(value, 6) AS value FROM m WHERE i BETWEEN 3 AND 20 AND j BETWEEN 3 AND 20", "pt")
def cropped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(ct.cropped(_map(spark, sf_dir), 3, 24))


@query(f"WITH {_M} SELECT key, 23 - j AS i, 23 - i AS j, round(value, 6) AS value FROM m", "pt")
def reversed_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(ct.reversed_bins(_map(spark, sf_dir), 24))


@query(f"WITH {_M}, p AS (SELECT i, j, row_number() OVER (ORDER BY i, j) - 1 AS k FROM range(0, 24) a(i), range(0, 24) b(j) WHERE j - i >= 2) SELECT key, m.i, m.j, CAST(p.k AS BIGINT) AS k FROM m JOIN p ON p.i = m.i AND p.j = m.j", "pt")
def packed_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.packed_index(_map(spark, sf_dir), 24, 2).select("key", "i", "j", "k")


_BAD = "bad AS (SELECT DISTINCT key, (key // 5 + d) % 24 AS bin FROM h, (VALUES (0), (7)) x(d))"


def _bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = points(spark, sf_dir).where("key % 5 = 0").select("key").distinct()
    return keys.select("key", F.explode(F.array(F.lit(0), F.lit(7))).alias("d")).select("key", ((F.floor(F.col("key") / 5) + F.col("d")) % 24).alias("bin"))


@query(f"WITH {_M}, {_BAD} SELECT key, i, j, round(value, 6) AS value FROM m WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.key = m.key AND bin IN (i, j))", "pt")
def masked_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(ct.without_bins(_map(spark, sf_dir), _bad(spark, sf_dir), ["key"]))


@query(f"WITH {_M} SELECT key, i, j, CAST(rank() OVER (PARTITION BY key, j - i ORDER BY value) AS INTEGER) AS rank FROM m", "pt")
def diagonal_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.diagonal_ranks(_map(spark, sf_dir), ["key"]).select("key", "i", "j", "rank")


@query(f"WITH {_M} SELECT a.key, a.i, b.i AS j, round(sqrt((a.v + 1) * (b.v + 1)) - 1, 6) AS geodot, abs(a.i - b.i) AS apart FROM h a JOIN h b ON b.key = a.key", "pt")
def geometric_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = points(spark, sf_dir).where("key % 5 = 0").groupBy("key", (F.floor(F.col("pos") / 3600) % 24).alias("i")).agg(F.count("*").cast("double").alias("v"))
    return ct.outer(h, ["key"], "i", "v").select("key", "i", "j", F.round("geodot", 6).alias("geodot"), "apart")


@query(f"WITH {_M}, {_BAD}, u AS (SELECT * FROM m WHERE i <= j AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.key = m.key AND bin IN (i, j))), t AS (SELECT key, j - i AS d, quantile_cont(value, 0.5) * 10 AS t FROM u GROUP BY ALL), c AS (SELECT u.key, i // 2 AS i, j // 2 AS j, avg(least(value, t)) AS v FROM u JOIN t ON t.key = u.key AND t.d = j - i GROUP BY ALL), e AS (SELECT key, j - i AS d, avg(v) AS e FROM c GROUP BY ALL), o AS (SELECT c.key, i, j, ln(v / e) AS v FROM c JOIN e ON e.key = c.key AND e.d = j - i), w AS (SELECT a.key, a.i, a.j, exp(-0.5 * (a.i - b.i) * (a.i - b.i)) * exp(-0.5 * (a.j - b.j) * (a.j - b.j)) AS w, b.v FROM o a JOIN o b ON b.key = a.key AND abs(a.i - b.i) <= 4 AND abs(a.j - b.j) <= 4) SELECT key, i, j, round(greatest(least(sum(w * v) / sum(w), 0.2), -0.2), 5) + 0 AS value FROM w GROUP BY ALL", "pt")
def read_contact_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw map as an example's target, by one operator."""
    done = ct.read_map(_map(spark, sf_dir).where("i <= j"), _bad(spark, sf_dir), ["key"], 2, 1.0, 0.2)
    return done.select("key", "i", "j", (F.round("value", 5) + 0).alias("value"))
