"""Signal operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.operators import signal as sg
from lociframe.plans.catalogue import intervals, points, query
from lociframe.session import table


def _r(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


@query("WITH b AS (SELECT key, pos // 86400 AS bin, v FROM pt), a AS (SELECT key, bin, sum(v) AS s, avg(v) AS m, quantile_cont(v, 0.5) AS md, max(v) AS mx FROM b GROUP BY key, bin) SELECT key, bin, round(s, 6) AS sum, round(CASE WHEN s >= -1 THEN sqrt(s + 1) - 1 END, 6) AS sum_sqrt, round(m, 6) AS mean, round(CASE WHEN m >= -1 THEN sqrt(m + 1) - 1 END, 6) AS mean_sqrt, round(md, 6) AS median, round(mx, 6) AS max, round(least(sqrt(greatest(4 * m, 0.0)), 1.0), 6) AS peak FROM a", "pt")
def pool_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sg.pooled(points(spark, sf_dir), 86400, list(sg.POOLS), ["key"], "pos", "v")
    return done.select("key", "bin", *_r("sum", "sum_sqrt", "mean", "mean_sqrt", "median", "max", "peak"))


@query("SELECT okey, line, round(CASE WHEN v > 30000 THEN 29999 + sqrt(v - 30000 + 1) ELSE v END, 6) AS soft, round(least(greatest(v, -40000.0), 40000.0), 6) AS hard, round(least(greatest(v, -65504.0), 65504.0), 6) AS half FROM iv", "iv")
def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return intervals(spark, sf_dir).select("okey", "line", F.round(sg.soft_clip(v, 30000), 6).alias("soft"), F.round(sg.hard_clip(v, 40000), 6).alias("hard"), F.round(sg.hard_clip(v), 6).alias("half"))


@query("WITH t AS (SELECT quantile_cont(v, 0.99) AS t FROM iv) SELECT okey, line, round(greatest(least(v, t), -t), 6) AS v FROM iv, t", "iv")
def extreme_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.clip_at_percentile(intervals(spark, sf_dir), 0.99, "v", "v").select("okey", "line", *_r("v"))


@query("WITH c AS (SELECT key, quantile_cont(v, 0.75) AS cap FROM iv GROUP BY key) SELECT okey, line, round(CASE WHEN line % 2 = 0 THEN least(v, cap) ELSE v END, 6) AS v FROM iv JOIN c ON c.key = iv.key", "iv")
def pct_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals(spark, sf_dir).withColumn("masked", F.col("line") % 2 == 0)
    return sg.cap_masked(rows, 0.75, ["key"], "v").select("okey", "line", *_r("v"))


@query("WITH x AS (SELECT id, key, CASE WHEN id % 10 = 0 THEN NULL ELSE v END AS v, id % 7 = 0 AS black FROM pt), b AS (SELECT key, CASE WHEN count(v) >= 8 THEN quantile_cont(v, 0.25) ELSE 0.0 END AS base FROM x GROUP BY key) SELECT id, round(base, 6) AS baseline, round(CASE WHEN v IS NULL THEN base WHEN black THEN greatest(least(v, base), -base) ELSE v END, 6) AS v FROM x JOIN b ON b.key = x.key", "pt")
def baseline_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).select("id", "key", F.when(F.col("id") % 10 != 0, F.col("v")).alias("v"), (F.col("id") % 7 == 0).alias("blacklisted"))
    return sg.baselined(rows, 0.25, ["key"], "v").select("id", *_r("baseline", "v"))


@query("WITH h AS (SELECT key, pos // 21600 AS bin, avg(v) AS v FROM pt GROUP BY ALL), g AS (SELECT key, unnest(range(0, 120)) AS bin FROM (SELECT DISTINCT key FROM pt)), x AS (SELECT g.key, g.bin, h.v FROM g LEFT JOIN h ON h.key = g.key AND h.bin = g.bin), n AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN bin END) OVER (PARTITION BY key ORDER BY bin ROWS UNBOUNDED PRECEDING) AS a, min(CASE WHEN v IS NOT NULL THEN bin END) OVER (PARTITION BY key ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM x) SELECT n.key, n.bin, round(CASE WHEN n.v IS NOT NULL THEN n.v WHEN n.a IS NULL OR n.b IS NULL THEN 0.0 ELSE p.v + (q.v - p.v) * (n.bin - n.a) / (n.b - n.a) END, 6) AS v FROM n LEFT JOIN x p ON p.key = n.key AND p.bin = n.a LEFT JOIN x q ON q.key = n.key AND q.bin = n.b", "pt")
def interp_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = points(spark, sf_dir).groupBy("key", F.floor(F.col("pos") / 21600).alias("bin")).agg(F.avg("v").alias("v"))
    grid = held.select("key").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(119).cast("bigint"))))
    return sg.interpolated(grid.join(held, ["key", "bin"], "left"), "key", "bin", "v").select("key", "bin", *_r("v"))


@query("SELECT key, id, round(avg(v) OVER (PARTITION BY key ORDER BY pos, id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM pt", "pt")
def moving_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).withColumn("at", F.struct("pos", "id"))
    return sg.moving_mean(rows, 5, "key", "at", "v").select("key", "id", *_r("smooth"))


@query("WITH d AS (SELECT key, pos // 3600 AS h, sum(v) AS v FROM pt GROUP BY ALL), k AS (SELECT x AS k, exp(-0.5 * (x / 1.5) ** 2) AS w FROM range(-6, 7) t(x)), n AS (SELECT k, w / (SELECT sum(w) FROM k) AS w FROM k) SELECT key, h + k AS pos, round(sum(v * w), 6) AS smooth FROM d, n GROUP BY ALL", "pt")
def gaussian_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = points(spark, sf_dir).groupBy("key", F.floor(F.col("pos") / 3600).alias("pos")).agg(F.sum("v").alias("v"))
    return sg.gaussian(held, 1.5, "key", "pos", "v").select("key", "pos", *_r("smooth"))


@query("WITH s AS (SELECT DISTINCT key, pos AS site FROM pt) SELECT s.key, site, round(sum(exp(-0.5 * pow((pos - site) / 3600.0, 2)) * v) / sum(exp(-0.5 * pow((pos - site) / 3600.0, 2))), 6) AS score FROM s JOIN pt ON pt.key = s.key AND abs(pos - site) <= 14400 GROUP BY ALL", "pt")
def score_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir)
    sites = rows.select("key", F.col("pos").alias("site")).distinct()
    return sg.smoothed_at(rows, sites, 3600, "key", "pos", "v").select("key", "site", *_r("score"))


@query("SELECT key, round(sum(v), 4) AS total, round(var_pop(v), 4) AS variance FROM pt GROUP BY key HAVING sum(v) <> 0 AND var_pop(v) > 1e-6", "pt")
def filter_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.varying(points(spark, sf_dir), ["key"], "v").select("key", F.round("total", 4).alias("total"), F.round("variance", 4).alias("variance"))


@query("WITH s AS (SELECT key, var_pop(v) AS variance FROM iv GROUP BY key) SELECT key, round(variance, 2) AS variance FROM s WHERE variance >= (SELECT quantile_cont(variance, 0.75) FROM s)", "iv")
def high_variance_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.high_variance(intervals(spark, sf_dir), 0.25, ["key"], "v").select("key", F.round("variance", 2).alias("variance"))


@query("SELECT l_returnflag AS target, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN l_discount <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS nonzero, round(avg(l_extendedprice), 4) AS mean, max(l_extendedprice) AS most FROM lineitem GROUP BY 1")
def target_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("target")).agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") != 0).alias("nonzero"), F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.max("l_extendedprice").alias("most"))
