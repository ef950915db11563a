"""Accuracy and rank statistics on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.operators import metrics as mt
from lociframe.plans.catalogue import points, query
from lociframe.session import table
from lociframe.streaming import metrics as st


def _r(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


_SUMS = "SELECT l_suppkey AS key, CAST(count(*) AS BIGINT) AS n, sum(l_quantity) AS sy, sum(l_extendedprice / 1000) AS sp, sum(l_quantity * l_quantity) AS syy, sum(l_extendedprice / 1000 * l_extendedprice / 1000) AS spp, sum(l_quantity * l_extendedprice / 1000) AS syp FROM lineitem GROUP BY 1"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_quantity").alias("y"), (F.col("l_extendedprice") / 1000).alias("p"), "l_orderkey", "l_linenumber")


@query(f"WITH m AS ({_SUMS}) SELECT key, n, round(CASE WHEN syy - sy * sy / n > 1e-12 AND spp - sp * sp / n > 1e-12 THEN (syp - sy * sp / n) / sqrt((syy - sy * sy / n) * (spp - sp * sp / n)) ELSE 0 END, 6) AS pearsonr, round(1 - (spp - 2 * syp + syy) / (syy - sy * sy / n), 6) AS r2, round(1 - ((syy - 2 * syp + spp) / n - pow((sy - sp) / n, 2)) / (syy / n - pow(sy / n, 2)), 6) AS explained FROM m")
def pearson_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.accuracy(_pairs(spark, sf_dir), ["key"], "y", "p").select("key", "n", *_r("pearsonr", "r2", "explained"))


@query("WITH r AS (SELECT l_suppkey AS key, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_suppkey, l_extendedprice) - 1) / 2.0::DOUBLE AS b FROM lineitem) SELECT key, CAST(count(*) AS BIGINT) AS n, round(corr(a, b), 6) AS spearmanr FROM r GROUP BY key")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.spearman(_pairs(spark, sf_dir), ["key"], "y", "p").select("key", "n", *_r("spearmanr"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("all", F.lit("all"))


@query("WITH x AS (SELECT quality = 1 AS y, n_chars AS s FROM labels JOIN documents USING (doc_id)) SELECT 'all' AS \"all\", CAST((SELECT count(*) FROM x) AS BIGINT) AS n, CAST((SELECT count(*) FROM x WHERE y) AS BIGINT) AS positives, round((SELECT avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) FROM x a JOIN x b ON a.y AND NOT b.y), 6) AS auroc")
def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).withColumn("y", F.col("quality") == 1)
    return mt.auroc(rows, ["all"], "y", "n_chars").select("all", "n", "positives", *_r("auroc"))


@query("WITH x AS (SELECT n_chars AS s, CAST(count(*) AS BIGINT) AS n, CAST(sum(quality) AS BIGINT) AS pos FROM labels JOIN documents USING (doc_id) GROUP BY 1), c AS (SELECT pos, sum(n) OVER w AS cn, sum(pos) OVER w AS tp FROM x WINDOW w AS (ORDER BY s DESC)) SELECT 'all' AS \"all\", round(sum(pos * tp::DOUBLE / cn) / sum(pos), 6) AS auprc FROM c")
def auprc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).withColumn("y", F.col("quality") == 1)
    return mt.auprc(rows, ["all"], "y", "n_chars").select("all", *_r("auprc"))


@query("WITH x AS (SELECT quality = 1 AS y, n_chars AS s, CASE WHEN n_chars > 0 AND n_chars <= 1000 THEN 0 WHEN n_chars > 1000 AND n_chars <= 3000 THEN 1 WHEN n_chars > 3000 AND n_chars <= 100000 THEN 2 END AS k FROM labels JOIN documents USING (doc_id)) SELECT CAST(a.k AS INTEGER) AS stratum, round(avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END), 6) AS auroc FROM x a JOIN x b ON a.k = b.k AND a.y AND NOT b.y GROUP BY a.k")
def stratified_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).withColumns({"y": F.col("quality") == 1, "stratum": mt.strata(F.col("n_chars"), [0, 1000, 3000, 100000])}).where("stratum is not null")
    done = mt.auroc(rows, ["stratum"], "y", "n_chars")
    return done.where((F.col("positives") > 0) & (F.col("positives") < F.col("n"))).select("stratum", *_r("auroc"))


_P = "SELECT l_orderkey AS o, l_linenumber AS l, l_suppkey AS key, pow((l_orderkey * 7919 + l_linenumber * 104729) % 10007 / 10007.0::DOUBLE, 3) AS p FROM lineitem"


def _p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.pow(((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 10007) / F.lit(10007.0), F.lit(3.0))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_suppkey").alias("key"), p.alias("p"))


@query(f"WITH t AS ({_P}), k AS (SELECT *, count(*) OVER (PARTITION BY key) AS m, row_number() OVER (PARTITION BY key ORDER BY p, o, l) AS k FROM t) SELECT o, l, round(least(1.0, min(p * m / k) OVER (PARTITION BY key ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM k")
def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.benjamini_hochberg(_p_values(spark, sf_dir), ["key"], "p", ["o", "l"]).select("o", "l", *_r("q"))


@query(f"WITH t AS ({_P}), k AS (SELECT *, count(*) OVER (PARTITION BY key) AS m, row_number() OVER (PARTITION BY key ORDER BY p, o, l) AS k FROM t) SELECT o, l, CAST(floor(p * m / k) AS DOUBLE) AS q FROM k")
def bh_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.benjamini_hochberg(_p_values(spark, sf_dir), ["key"], "p", ["o", "l"], legacy=True).select("o", "l", "q")


_CELLS = "SELECT l_suppkey AS key, CAST(month(l_shipdate) AS INTEGER) AS m, sum(l_quantity) AS v FROM lineitem GROUP BY ALL"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("key"), F.month("l_shipdate").alias("m")).agg(F.sum("l_quantity").alias("v"))


@query(f"WITH c AS ({_CELLS}), r AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY v, key) AS k FROM c), a AS (SELECT k, avg(v) AS v, quantile_cont(v, 0.5) AS md FROM r GROUP BY k) SELECT key, r.m, round(a.v, 6) AS v, round(a.md, 6) AS md FROM r JOIN a ON a.k = r.k")
def quantile_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    mean = mt.quantile_normalised(cells, ["key"], "m", "v").select("key", "m", *_r("v"))
    return mean.join(mt.quantile_normalised(cells, ["key"], "m", "v", "median").select("key", "m", F.round("v", 6).alias("md")), ["key", "m"])


@query(f"WITH c AS ({_CELLS}), r AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY v, key) AS k FROM c), a AS (SELECT k, avg(v) AS v FROM r GROUP BY k), n AS (SELECT r.key, r.m, a.v, c2.v AS raw FROM r JOIN a ON a.k = r.k JOIN c c2 ON c2.key = r.key AND c2.m = r.m), d AS (SELECT key, m, v - avg(v) OVER (PARTITION BY key) AS y, raw - avg(raw) OVER (PARTITION BY key) AS p FROM n) SELECT m, CAST(count(*) AS BIGINT) AS n, round(corr(y, p), 6) AS pearsonr FROM d GROUP BY m", "")
def specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy per target of what is left when the row's mean over targets is taken off."""
    cells = _cells(spark, sf_dir)
    both = mt.quantile_normalised(cells, ["key"], "m", "v").join(cells.select("key", "m", F.col("v").alias("raw")), ["key", "m"])
    means = both.groupBy("key").agg(F.avg("v").alias("mv"), F.avg("raw").alias("mr"))
    apart = both.join(means, "key").select("m", (F.col("v") - F.col("mv")).alias("y"), (F.col("raw") - F.col("mr")).alias("p"))
    return mt.accuracy(apart, ["m"], "y", "p").select("m", "n", *_r("pearsonr"))


@query("WITH t AS (SELECT l_suppkey AS key, l_quantity AS y, l_extendedprice / 1000 AS p FROM lineitem), s AS (SELECT key, count(*) AS n, sum(y) AS sy, sum(p) AS sp, sum(p + 1e-6) AS sb, sum((y + 1e-6) * ln(p + 1e-6)) AS c, sum(y + 1e-6) AS sa, avg((y - p) * (y - p)) - avg(y * p) AS udot, avg(p - y * ln(p + 1e-3)) AS pk, sum(y + 1e-3) AS ka, sum(p + 1e-3) AS kb, sum((y + 1e-3) * ln((y + 1e-3) / (p + 1e-3))) AS kc FROM t GROUP BY key) SELECT key, round(-(c - sa * ln(sb)) / n + (sp - sy * ln(sp + 1e-6)) / n, 5) AS multinomial, round(pk + kc / ka - ln(ka / kb), 5) AS kl, round(udot, 4) AS udot FROM s")
def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir)
    a = mt.poisson_multinomial(rows, ["key"], "y", "p").select("key", F.round("loss", 5).alias("multinomial"))
    b = mt.poisson_kl(rows, ["key"], "y", "p").select("key", F.round("loss", 5).alias("kl"))
    return a.join(b, "key").join(mt.mse_udot(rows, ["key"], "y", "p").select("key", F.round("loss", 4).alias("udot")), "key")


@query("WITH d AS (SELECT l_suppkey AS key, l_quantity - l_linenumber * 8 AS d FROM lineitem), z AS (SELECT key, d, rank() OVER (PARTITION BY key ORDER BY abs(d)) + (count(*) OVER (PARTITION BY key, abs(d)) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY key, abs(d)) AS c FROM d WHERE d <> 0), w AS (SELECT key, CAST(count(*) AS BIGINT) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(c * c - 1.0::DOUBLE) AS ties FROM z GROUP BY key), t AS (SELECT key, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM d GROUP BY key) SELECT w.key, n, round(w_plus, 6) AS w_plus, round((w_plus - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - ties / 48), 6) AS z, round(t, 6) AS t FROM w JOIN t ON t.key = w.key")
def paired_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_quantity").alias("a"), (F.col("l_linenumber") * 8).cast("double").alias("b"))
    return mt.signed_rank(rows, ["key"], "a", "b").select("key", "n", *_r("w_plus", "z", "t"))


@query("WITH c AS (SELECT key, pos // 86400 AS bin, CAST(count(*) AS BIGINT) AS y FROM pt GROUP BY ALL), r AS (SELECT key, avg(y) AS rate FROM c GROUP BY key), p AS (SELECT c.key, bin, y, greatest(0.0, 1 - (SELECT coalesce(sum(exp(-rate + i * ln(rate) - lgamma(i + 1))), 0) FROM range(0, 60) t(i) WHERE i < y)) AS p FROM c JOIN r ON r.key = c.key), k AS (SELECT *, count(*) OVER (PARTITION BY key) AS m, row_number() OVER (PARTITION BY key ORDER BY p, bin) AS k FROM p) SELECT key, bin, y, round(p, 6) AS p, round(least(1.0, min(p * m / k) OVER (PARTITION BY key ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM k", "pt")
def test_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = points(spark, sf_dir).groupBy("key", F.floor(F.col("pos") / 86400).alias("bin")).agg(F.count("*").alias("y"))
    return mt.called_peaks(counts, ["key"], "y", ["bin"]).select("key", "bin", "y", *_r("p", "q"))


@query("WITH f AS (SELECT l_returnflag AS k, l_suppkey % 10 AS f, avg(l_discount) AS m FROM lineitem GROUP BY ALL) SELECT k, round(avg(m), 6) AS mean, round(stddev_samp(m) / sqrt(count(*)), 6) AS sem, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY k")
def read_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("k"), (F.col("l_suppkey") % 10).alias("f"), "l_discount")
    return mt.mean_of_means(rows, ["k"], ["f"], "l_discount").select("k", *_r("mean", "sem"), "n")


@query("WITH t AS (SELECT event_type AS k, date_trunc('day', ts) AS d, value AS y, CAST(user_id AS DOUBLE) AS p FROM events) SELECT k, strftime(d, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS n, round(CASE WHEN var_pop(y) > 0 AND var_pop(p) > 0 THEN corr(y, p) ELSE 0 END, 6) AS pearsonr FROM t GROUP BY ALL")
def windowed_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("k"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("y"), F.col("user_id").cast("double").alias("p"))
    return st.windowed_accuracy(rows, "ts", ["k"], "y", "p").select("k", F.date_format("start", "yyyy-MM-dd").alias("day"), "n", *_r("pearsonr"))


@query("WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS o FROM events), s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS c FROM g) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(count(*) AS BIGINT) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, c")
def session_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return st.session_sums(rows, "ts", ["user_id"], "value").select("user_id", F.unix_timestamp("start").alias("start"), "n", *_r("total"))
