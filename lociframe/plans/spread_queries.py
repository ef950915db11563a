"""Ordered operators with keys that span several tasks, against the SQL of those that do not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.operators import analysis as an
from lociframe.operators import genes as gn
from lociframe.operators import intervals as iv
from lociframe.operators import metrics as mt
from lociframe.operators import signal as sg
from lociframe.operators import splits as sp
from lociframe.plans import metric_queries as mq
from lociframe.plans.catalogue import ORACLES, intervals, points, query
from lociframe.session import table


@query(ORACLES["interval_merge"])
def merge_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.merge(intervals(spark, sf_dir), "key", "s", "e", spread=True).select("key", "s", "e", "n")


@query(ORACLES["rejoin_adjacent"])
def rejoin_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = intervals(spark, sf_dir).groupBy("key").agg(F.min("s").alias("start"), F.max("e").alias("end"))
    pieces = spans.withColumn("cut", F.explode(F.sequence("start", F.col("end") - 1, F.lit(7).cast("bigint"))))
    pieces = pieces.select("key", F.col("cut").alias("start"), F.least(F.col("cut") + 7, F.col("end")).alias("end"))
    return iv.rejoin(pieces, spread=True).select("key", F.col("start").alias("s"), F.col("end").alias("e"))


@query(ORACLES["cluster_chain"])
def chain_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = iv.chain(points(spark, sf_dir), 7200, spread=True)
    return done.groupBy("key", F.col("cluster").cast("bigint").alias("cluster")).agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n"))


@query(ORACLES["cluster_greedy"])
def greedy_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.greedy(points(spark, sf_dir), 86400, spread=True)


@query(ORACLES["run_length"])
def runs_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).withColumn("at", F.struct("pos", "id"))
    return iv.runs(rows, F.col("v") < 50, "key", "at", 2, spread=True).select("key", F.col("first.pos").alias("first"), F.col("last.pos").alias("last"), "n")


@query(ORACLES["bedgraph_collapse"])
def disjoin_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals(spark, sf_dir).select(F.col("okey").alias("key"), F.col("s").alias("start"), F.col("e").alias("end"), F.col("line").cast("double").alias("value"))
    return iv.disjoin(rows, spread=True).select("key", "start", "end", "depth", F.round("mean", 6).alias("mean"))


@query(ORACLES["anti_overlap"])
def anti_overlap_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.without_overlaps(intervals(spark, sf_dir, "l_partkey"), "key", "okey", "s", "e", spread=True).select(F.col("key").alias("part"), "okey", "s", "e")


@query(ORACLES["active_blocks"])
def active_blocks_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = points(spark, sf_dir).groupBy("key", F.floor(F.col("pos") / 600).alias("b")).agg(F.count("*").alias("n"))
    return gn.active_blocks(held, 24, "key", "b", "n", spread=True)


@query(ORACLES["spearman"])
def spearman_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.spearman(mq._pairs(spark, sf_dir), ["key"], "y", "p", spread=True).select("key", "n", *mq._r("spearmanr"))


@query(ORACLES["bh_fdr"])
def bh_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.benjamini_hochberg(mq._p_values(spark, sf_dir), ["key"], "p", spread=True).select("o", "l", *mq._r("q"))


@query(ORACLES["quantile_norm"])
def quantile_norm_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = mq._cells(spark, sf_dir)
    mean = mt.quantile_normalised(cells, ["key"], "m", "v", spread=True).select("key", "m", *mq._r("v"))
    return mean.join(mt.quantile_normalised(cells, ["key"], "m", "v", "median", spread=True).select("key", "m", F.round("v", 6).alias("md")), ["key", "m"])


@query("WITH k AS (SELECT event_id AS id, row_number() OVER (ORDER BY (event_id * 48271) % 65537, event_id) AS k, count(*) OVER () AS n FROM events) SELECT id FROM k WHERE k <= floor(n * 0.25)")
def sample_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    return sp.sampled(rows, 0.25, F.struct((F.col("id") * 48271) % 65537, "id"))


@query("WITH k AS (SELECT event_id AS id, row_number() OVER (ORDER BY value, event_id) - 1 AS k, count(*) OVER () AS n FROM events) SELECT id, CAST((SELECT max(q) FROM range(0, 7) t(q) WHERE q * n // 7 <= k) AS INTEGER) AS quantile FROM k")
def buckets_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.equal_buckets(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "value"), "value", 7, "id").select("id", "quantile")


@query("SELECT o_orderkey AS o, o_custkey AS c FROM orders")
def sorted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that come in the order of their numbers pass as they are."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("c"), (F.floor(F.col("o_orderkey") / 100)).alias("k"), (F.col("o_orderkey") % 100).alias("p"))
    return sp.assert_sorted(rows, "o", "k", "p").select("o", "c")


_DEEP = "y AS (SELECT l_suppkey AS key, year(l_shipdate) AS bin, CAST(sum(l_quantity * l_linenumber) AS BIGINT) AS y, round(avg(l_extendedprice), 4) AS p FROM lineitem GROUP BY ALL), r AS (SELECT key, avg(y) AS rate FROM y GROUP BY key), t AS (SELECT y.key, bin, y, p AS pred, CASE WHEN y > rate THEN (SELECT sum(exp(i * ln(rate) - rate - lgamma(i + 1))) FROM range(0, 1500) x(j), (SELECT y + j AS i) z) ELSE 1 - (SELECT sum(exp(i * ln(rate) - rate - lgamma(i + 1))) FROM range(1, 1500) x(j), (SELECT y - j AS i) z WHERE i >= 0) END AS p FROM y JOIN r ON r.key = y.key), k AS (SELECT *, count(*) OVER (PARTITION BY key) AS m, row_number() OVER (PARTITION BY key ORDER BY p, bin) AS k FROM t), q AS (SELECT key, bin, y, pred, p, least(1.0, min(p * m / k) OVER (PARTITION BY key ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS q FROM k)"


def _deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of hundreds to many thousands."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("key"), F.year("l_shipdate").cast("bigint").alias("bin"))
    return rows.agg(F.sum(F.col("l_quantity") * F.col("l_linenumber")).cast("bigint").alias("y"), F.round(F.avg("l_extendedprice"), 4).alias("p"))


@query(f"WITH {_DEEP} SELECT key, bin, y, round(p, 6) AS p, round(q, 6) AS q, q < 0.01 AS peak FROM q")
def deep_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _deep(spark, sf_dir).withColumnRenamed("p", "pred")
    return mt.called_peaks(rows, ["key"], "y", ["bin"]).select("key", "bin", "y", *mq._r("p", "q"), "peak")


@query(f"WITH {_DEEP}, e AS (SELECT key, pred, q < 0.01 AS y FROM q), n AS (SELECT key, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE y) AS BIGINT) AS peaks FROM e GROUP BY key), a AS (SELECT a.key, avg(CASE WHEN a.pred > b.pred THEN 1.0 WHEN a.pred = b.pred THEN 0.5 ELSE 0 END) AS auroc FROM e a JOIN e b ON b.key = a.key AND a.y AND NOT b.y GROUP BY a.key), c AS (SELECT key, y, sum(CASE WHEN y THEN 1 ELSE 0 END) OVER w AS tp, count(*) OVER w AS cn FROM e WINDOW w AS (PARTITION BY key ORDER BY pred DESC)), p AS (SELECT key, sum(CASE WHEN y THEN tp::DOUBLE / cn ELSE 0 END) AS s FROM c GROUP BY key) SELECT n.key, n, peaks, round(coalesce(auroc, 0.5), 6) AS auroc, round(CASE WHEN peaks > 0 THEN s / peaks ELSE 0 END, 6) AS auprc FROM n LEFT JOIN a ON a.key = n.key LEFT JOIN p ON p.key = n.key")
def peak_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bin counts here, as a supplier has only a few years."""
    done = mt.peak_accuracy(_deep(spark, sf_dir), ["key"], "y", "p", every=1, spread=True)
    return done.select("key", "n", "peaks", *mq._r("auroc", "auprc"))


@query("WITH m AS (SELECT okey, line, key, v, line > 4 AS masked FROM iv), c AS (SELECT key, quantile_cont(v, 0.25) AS c FROM m GROUP BY key) SELECT okey, line, m.key, round(CASE WHEN masked THEN least(v, c) ELSE v END, 6) AS v FROM m JOIN c ON c.key = m.key", "iv")
def cap_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals(spark, sf_dir).withColumn("masked", F.col("line") > 4)
    return sg.cap_masked(rows, 0.25, ["key"], "v", spread=True).select("okey", "line", "key", F.round("v", 6).alias("v"))


@query("WITH n AS (SELECT key, max(e) AS length FROM iv GROUP BY key), o AS (SELECT key, length, sum(length) OVER (ORDER BY key) - length AS ofs FROM n), p AS (SELECT DISTINCT (okey * 7919 + line * 31) % 200000 AS place FROM iv) SELECT CAST(place AS BIGINT) AS place, key, CAST(place - ofs AS BIGINT) AS pos FROM p JOIN o ON place >= ofs AND place < ofs + length", "iv")
def genome_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places on the joined genome as chromosomes and positions, both ways that there are."""
    rows = intervals(spark, sf_dir)
    laid = iv.offsets(rows.groupBy("key").agg(F.max("e").alias("length")))
    places = rows.select(((F.col("okey") * 7919 + F.col("line") * 31) % 200000).alias("place")).distinct()
    return iv.from_offset(places, laid).select("place", "key", "pos")
