"""Genes against windows, and tables over genes, targets and replicates, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.operators import analysis as an
from lociframe.operators import genes as gn
from lociframe.plans.catalogue import intervals, points, query
from lociframe.session import table
from lociframe.sources import examples as ex


def _r(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


@query("WITH w AS (SELECT DISTINCT key, s // 256 * 256 AS ws FROM iv), m AS (SELECT ws, w.key, okey, greatest(s - ws, 0) AS a, least(e - ws, 256) AS b FROM w JOIN iv ON iv.key = w.key AND s < ws + 256 AND ws < e), b AS (SELECT *, CAST(round_even(a / 16.0, 0) AS BIGINT) AS f, CAST(round_even(b / 16.0, 0) AS BIGINT) AS l FROM m) SELECT DISTINCT key, ws, okey, unnest(range(f, l)) AS bin FROM b WHERE l > f", "iv")
def gene_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals(spark, sf_dir)
    windows = rows.select(F.col("key").alias("chrom"), (F.floor(F.col("s") / 256) * 256).alias("start")).distinct()
    windows = windows.select(F.struct(F.col("chrom").alias("key"), F.col("start").alias("ws")).alias("snp_id"), "chrom", "start", (F.col("start") + 256).alias("end"))
    segments = rows.select(F.col("okey").alias("gene_id"), F.col("key").alias("chrom"), F.col("s").alias("start"), F.col("e").alias("end"))
    return gn.gene_bins(windows, segments, 16, width=256).select("snp_id.key", "snp_id.ws", F.col("gene_id").alias("okey"), "bin")


@query("WITH t AS (SELECT key, unnest(range(CAST(min(s) AS BIGINT) // 64, CAST(max(e) AS BIGINT) // 64 + 1)) AS t FROM iv GROUP BY key), m AS (SELECT okey, (t % 10)::DOUBLE AS v, least(e, t * 64 + 64) - greatest(s, t * 64) AS o FROM iv JOIN t ON t.key = iv.key AND s < t * 64 + 64 AND t * 64 < e) SELECT okey, round(sum(v * o), 6) AS total, round(sum(v * o) / sum(o), 6) AS mean FROM m GROUP BY okey", "iv")
def genes_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals(spark, sf_dir)
    tiles = rows.groupBy(F.col("key").alias("chrom")).agg(F.floor(F.min("s") / 64).alias("a"), F.floor(F.max("e") / 64).alias("b"))
    track = tiles.select("chrom", F.explode(F.sequence("a", "b")).alias("t")).select("chrom", (F.col("t") * 64).alias("start"), (F.col("t") * 64 + 64).alias("end"), (F.col("t") % 10).cast("double").alias("value"))
    genes = rows.select(F.col("okey").alias("gene_id"), F.col("key").alias("chrom"), F.col("s").alias("start"), F.col("e").alias("end"))
    return gn.interval_sums(genes, track, width=64).select(F.col("gene_id").alias("okey"), *_r("total", "mean"))


@query("WITH seg AS (SELECT key, unnest(range(0, 30, 2)) AS d FROM (SELECT DISTINCT key FROM pt)), s AS (SELECT key, d * 86400 AS a, d * 86400 + 86400 AS b, CASE WHEN (key + d) % 6 = 0 THEN 'test' ELSE 'train' END AS split FROM seg), p AS (SELECT pt.id, pt.key, s.split FROM pt LEFT JOIN s ON s.key = pt.key AND pos >= a AND pos < b), v AS (SELECT key, split, count(*) AS n FROM p WHERE split IS NOT NULL GROUP BY ALL), f AS (SELECT key, split, row_number() OVER (PARTITION BY key ORDER BY n DESC, split) AS k FROM v) SELECT p.id, coalesce(p.split, f.split) AS split FROM p LEFT JOIN f ON f.key = p.key AND k = 1", "pt")
def split_of_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).withColumnRenamed("key", "chrom")
    day = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(28).cast("bigint"), F.lit(2).cast("bigint"))).alias("d")
    segments = rows.select("chrom").distinct().select("chrom", day)
    segments = segments.select("chrom", (F.col("d") * 86400).alias("start"), (F.col("d") * 86400 + 86400).alias("end"), F.when((F.col("chrom") + F.col("d")) % 6 == 0, "test").otherwise("train").alias("split"))
    return gn.split_of_points(rows, segments, "chrom").select("id", "split")


@query("WITH h AS (SELECT DISTINCT key, pos // 600 AS b FROM pt), g AS (SELECT key, b, CASE WHEN b - lag(b) OVER (PARTITION BY key ORDER BY b) - 1 < 24 THEN 0 ELSE 1 END AS o FROM h), i AS (SELECT key, b, sum(o) OVER (PARTITION BY key ORDER BY b) AS g FROM g) SELECT key, min(b) AS start, max(b) + 1 AS \"end\" FROM i GROUP BY key, g", "pt")
def active_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = points(spark, sf_dir).groupBy("key", F.floor(F.col("pos") / 600).alias("b")).agg(F.count("*").alias("n"))
    return gn.active_blocks(held, 24, "key", "b", "n")


@query("SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'CHIP/' || c_mktsegment WHEN 1 THEN c_mktsegment ELSE '*' END AS class FROM customer")
def description_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    label = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("CHIP:"), "c_mktsegment", F.lit(":x"))).when(F.col("c_custkey") % 3 == 1, F.concat("c_mktsegment", F.lit(":y"))).otherwise(F.col("c_mktsegment"))
    return c.select(F.col("c_custkey").alias("id"), gn.description_class(label).alias("class"))


@query("WITH f AS (SELECT key, s // 256 AS w, s % 256 // 16 AS bin, line > 1 AS flag FROM iv), m AS (SELECT key, w, count(*) FILTER (WHERE flag) / 16.0::DOUBLE AS share, count(*) FILTER (WHERE flag AND bin IN (7, 8)) AS hit FROM f GROUP BY ALL) SELECT key, w, round(share, 6) AS share FROM m WHERE share < 0.9 AND hit = 0", "iv")
def mappable_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals(spark, sf_dir)
    flags = rows.select("key", F.floor(F.col("s") / 256).alias("w"), F.floor(F.col("s") % 256 / 16).alias("bin"), (F.col("line") > 1).alias("flag"))
    return gn.mappable(flags, ["key", "w"], 0.9, 16).join(gn.clear_middle(flags, ["key", "w"], 16), ["key", "w"], "left_semi").select("key", "w", *_r("share"))


_LOGS = "SELECT l_suppkey AS t, l_quantity AS raw, log2(l_quantity + 1) AS y, log2(l_extendedprice + 1) AS p FROM lineitem"


@query(f"WITH x AS ({_LOGS}), r AS (SELECT t, raw, rank() OVER (PARTITION BY t ORDER BY y) + (count(*) OVER (PARTITION BY t, y) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY t ORDER BY p) + (count(*) OVER (PARTITION BY t, p) - 1) / 2.0::DOUBLE AS b FROM x), s AS (SELECT t, corr(a, b) AS s FROM r GROUP BY t) SELECT x.t, round(corr(y, p), 6) AS pearsonr_all, round(any_value(s), 6) AS spearmanr_all, round(corr(y, p) FILTER (WHERE raw <> 0), 6) AS pearsonr_nonzero FROM x JOIN s ON s.t = x.t GROUP BY x.t")
def cor_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "t")
    return an.correlation_table(rows, ["t"], "l_quantity", "l_extendedprice").select("t", *_r("pearsonr_all", "spearmanr_all", "pearsonr_nonzero"))


@query("WITH g AS (SELECT l_suppkey AS g, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1), k AS (SELECT g, row_number() OVER (ORDER BY v, g) - 1 AS k, count(*) OVER () AS n FROM g), q AS (SELECT g, (SELECT max(q) FROM range(0, 4) t(q) WHERE q * n // 4 <= k) AS q FROM k) SELECT l_returnflag AS t, CAST(q AS INTEGER) AS quantile, CAST(count(*) AS BIGINT) AS n, round(corr(l_quantity, l_extendedprice), 6) AS pearsonr FROM lineitem JOIN q ON g = l_suppkey GROUP BY ALL")
def quantile_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_suppkey": "g", "l_returnflag": "t"})
    return an.accuracy_by_quantile(rows, "g", ["t"], "l_quantity", "l_extendedprice", F.avg("l_extendedprice")).select("t", "quantile", "n", *_r("pearsonr"))


@query("SELECT l_suppkey AS g, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, round(avg(pow(l_quantity - l_linenumber, 2)), 6) AS mse, round(stddev_pop(l_quantity) / avg(l_quantity), 6) AS cv FROM lineitem GROUP BY 1")
def variance_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.gene_variance(table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "g"), "g", "l_quantity", "l_linenumber").select("g", *_r("mean", "std", "mse", "cv"))


_CELLS = "SELECT l_suppkey AS g, CAST(month(l_shipdate) AS INTEGER) AS m, sum(l_quantity) AS v FROM lineitem GROUP BY ALL"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("g"), F.month("l_shipdate").alias("m")).agg(F.sum("l_quantity").alias("v"))


@query(f"WITH c AS ({_CELLS}) SELECT a.m AS a, b.m AS b, CAST(count(*) AS BIGINT) AS n, round(corr(a.v, b.v), 6) AS pearsonr FROM c a JOIN c b ON b.g = a.g AND a.m < b.m GROUP BY ALL")
def replicate_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.pairwise_correlations(_cells(spark, sf_dir), "g", "m", "v").select("a", "b", "n", *_r("pearsonr"))


@query(f"WITH c AS ({_CELLS}), x AS (SELECT a.m AS f, b.m AS t, a.v AS x, b.v AS y FROM c a JOIN c b ON b.g = a.g WHERE a.m <= 3 AND b.m > 9), r AS (SELECT f, t, rank() OVER (PARTITION BY f, t ORDER BY x) + (count(*) OVER (PARTITION BY f, t, x) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY f, t ORDER BY y) + (count(*) OVER (PARTITION BY f, t, y) - 1) / 2.0::DOUBLE AS b FROM x) SELECT f, t, round(corr(a, b), 6) AS spearmanr FROM r GROUP BY ALL")
def filter_target_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    a = cells.where("m <= 3").select("g", F.col("m").alias("f"), F.col("v").alias("value"))
    b = cells.where("m > 9").select("g", F.col("m").alias("t"), F.col("v").alias("value"))
    return an.cross_spearman(a, b, "g", "f", "t").select("f", "t", *_r("spearmanr"))


@query(f"WITH c AS ({_CELLS}), s AS (SELECT g, m, CASE WHEN m = 12 THEN v * 100 ELSE v END AS v FROM c), t AS (SELECT m, avg(v) AS a FROM s GROUP BY m), k AS (SELECT m FROM t WHERE a <= 10 * (SELECT avg(a) FROM t) AND a >= (SELECT avg(a) FROM t) / 10), l AS (SELECT g, s.m, log2(v + 1) AS v FROM s JOIN k ON k.m = s.m), r AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY v, g) AS k FROM l), q AS (SELECT k, avg(v) AS v FROM r GROUP BY k) SELECT g, m, round(q.v, 6) AS v FROM r JOIN q ON q.k = r.k")
def normalize_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir).withColumn("v", F.when(F.col("m") == 12, F.col("v") * 100).otherwise(F.col("v")))
    return an.normalised_targets(cells, "g", "m", "v").select("g", "m", *_r("v"))


@query("WITH p AS (SELECT l_orderkey AS o, l_returnflag AS t, var_pop(l_quantity) AS v FROM lineitem GROUP BY ALL) SELECT o, round(max(v), 6) AS variance FROM p GROUP BY o HAVING max(v) > 0.01")
def filter_boring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.varied_segments(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o"), "o", "l_returnflag", "l_quantity").select("o", *_r("variance"))


@query(f"WITH c AS ({_CELLS}), d AS (SELECT g, m, v - 100 AS d FROM c), e AS (SELECT g, m, d - avg(d) OVER (PARTITION BY g) AS d FROM d) SELECT m, round(avg(d), 5) AS mean, round(var_pop(d), 4) AS variance FROM e GROUP BY m")
def motif_insertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cells(spark, sf_dir).withColumn("base", F.lit(100.0))
    return an.insertion_effects(rows, "g", "m", "v").select("m", F.round("mean", 5).alias("mean"), F.round("variance", 4).alias("variance"))


@query("WITH s AS (SELECT DISTINCT key, pos AS site FROM pt) SELECT s.key, site, round(avg(v), 6) AS score FROM s JOIN pt ON pt.key = s.key AND abs(pos - site) <= 7200 GROUP BY ALL", "pt")
def score_sites_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir)
    sites = rows.select("key", F.col("pos").alias("site")).distinct()
    return an.plain_window_score(rows, sites, 7200, "key", "pos", "v").select("key", "site", *_r("score"))


@query("WITH r AS (SELECT key, v, row_number() OVER (PARTITION BY key ORDER BY pos, id) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM pt) SELECT key, CAST(k AS INTEGER) AS k, round(sum(v * cos(2 * pi() * k * i / n)), 4) AS re, round(-sum(v * sin(2 * pi() * k * i / n)), 4) + 0 AS im FROM r, range(0, 8) t(k) WHERE k <= n // 2 GROUP BY ALL", "pt")
def fourier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).withColumn("at", F.struct("pos", "id"))
    return an.spectrum(rows, ["key"], "at", "v", 8).select("key", "k", F.round("re", 4).alias("re"), (F.round("im", 4) + 0).alias("im"))


@query("SELECT key, pos // 3600 % 24 AS hour, round(avg(v), 6) AS ref, round(avg(v * 2), 6) AS alt, round(avg(v * 2 - v), 6) AS diff FROM pt GROUP BY ALL", "pt")
def snp_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).select("key", (F.floor(F.col("pos") / 3600) % 24).alias("hour"), F.col("v").alias("ref"), (F.col("v") * 2).alias("alt"))
    return an.tracks(rows, ["key"], "hour").select("key", "hour", *_r("ref", "alt", "diff"))


@query("WITH c AS (SELECT key, CAST(pos // 3600 % 24 AS INTEGER) AS b, CAST(id % 3 AS INTEGER) AS t, sum(v) AS v FROM pt GROUP BY ALL), g AS (SELECT k.key, CAST(b AS INTEGER) AS b, CAST(t AS INTEGER) AS t FROM (SELECT DISTINCT key FROM pt) k, range(0, 24) x(b), range(0, 3) y(t)) SELECT g.key, g.b AS bin, g.t AS target_id, round(coalesce(c.v, 0), 2) AS value FROM g LEFT JOIN c ON c.key = g.key AND c.b = g.b AND c.t = g.t", "pt")
def example_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = points(spark, sf_dir).groupBy(F.col("key").alias("seq_id"), (F.floor(F.col("pos") / 3600) % 24).cast("int").alias("bin"), (F.col("id") % 3).cast("int").alias("target_id")).agg(F.sum("v").alias("value"))
    done = ex.long(ex.stacked(bins, 24, 3))
    return done.select(F.col("seq_id").alias("key"), "bin", "target_id", F.round(F.col("value").cast("double"), 2).alias("value"))


@query("WITH x AS (SELECT quality = 1 AS y, n_chars AS s FROM labels JOIN documents USING (doc_id) WHERE n_chars IS NOT NULL), c AS (SELECT s, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT coalesce(y, false)) AS q FROM x GROUP BY s), r AS (SELECT s, sum(q) OVER (ORDER BY s DESC) / (sum(q) OVER ())::DOUBLE AS x, sum(p) OVER (ORDER BY s DESC) / (sum(p) OVER ())::DOUBLE AS y FROM c), l AS (SELECT x, y, coalesce(lag(x) OVER (ORDER BY s DESC), 0) AS x0, coalesce(lag(y) OVER (ORDER BY s DESC), 0) AS y0 FROM r), k AS (SELECT k, y0 + (y - y0) * (k / 255.0::DOUBLE - x0) / (x - x0) AS v FROM l, range(0, 256) t(k) WHERE x > x0 AND k >= ceil(x0 * 255) AND k <= floor(x * 255)) SELECT 'all' AS t, CAST(k AS INTEGER) AS k, round(k / 255.0::DOUBLE, 6) AS fpr, round(max(v), 6) AS tpr FROM k GROUP BY k")
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.lit("all").alias("t"), (F.col("quality") == 1).alias("y"), "n_chars")
    return an.roc_points(rows, ["t"], "y", "n_chars").select("t", "k", *_r("fpr", "tpr"))


@query("WITH d AS (SELECT l_suppkey AS g, l_linenumber AS t, CAST(month(l_shipdate) AS INTEGER) AS m, min(l_partkey) AS pos, log2(sum(l_quantity) + 1) AS y, log2(sum(l_extendedprice) / 1000 + 1) AS p FROM lineitem GROUP BY ALL), v AS (SELECT g, t, var_pop(y) AS v, min(pos) AS q FROM d GROUP BY ALL), f AS (SELECT g, max(struct_pack(v := v, t := t, q := q)) AS f FROM v WHERE v > 0 GROUP BY g), o AS (SELECT v.g, f.f.t AS a, max(struct_pack(v := v.v, t := v.t)).t AS b FROM v JOIN f ON f.g = v.g WHERE v.v > 0 AND v.t <> f.f.t AND abs(v.q - f.f.q) >= 1 GROUP BY ALL), r AS (SELECT o.g, a, b, x.y - z.y AS y, x.p - z.p AS p FROM o JOIN d x ON x.g = o.g AND x.t = a JOIN d z ON z.g = o.g AND z.t = b AND z.m = x.m) SELECT g AS gene_id, a, b, CAST(count(*) AS BIGINT) AS n, round(CASE WHEN var_pop(y) > 1e-13 AND var_pop(p) > 1e-13 THEN corr(y, p) ELSE 0 END, 6) AS pearsonr, round(CASE WHEN stddev_samp(y) > 0 THEN avg(y) / (stddev_samp(y) / sqrt(count(*))) END, 6) AS t FROM r GROUP BY ALL")
def alternative_tss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("gene_id"), F.col("l_linenumber").alias("tss_id"), F.month("l_shipdate").alias("target_id")).agg(F.min("l_partkey").alias("pos"), F.sum("l_quantity").alias("y"), (F.sum("l_extendedprice") / 1000).alias("p"))
    return an.alternative_starts(rows, 1).select("gene_id", "a", "b", "n", *_r("pearsonr", "t"))


@query("WITH t AS (SELECT l_partkey % 50 AS g, l_returnflag AS t, l_quantity AS v FROM lineitem) SELECT t AS target_id, round(quantile_cont(v, 0.25), 6) AS pseudo FROM t WHERE g < 25 GROUP BY t")
def tissue_pseudocount(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.concat(F.lit("ENSG"), (F.col("l_partkey") % 50).cast("string"), F.lit(".3"))
    rows = table(spark, sf_dir, "lineitem").select(g.alias("gene_id"), F.col("l_returnflag").alias("target_id"), F.col("l_quantity").alias("value"))
    ids = spark.range(25).select(F.concat(F.lit("ENSG"), F.col("id").cast("string"), F.lit(".1")).alias("gene_id"))
    return an.pseudocount(rows, ids, 0.25).select("target_id", *_r("pseudo"))
