"""Variant effect scores, percentile grids and what is built on them, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.functions import transforms as tf
from lociframe.operators import graph, scores as sc
from lociframe.plans.catalogue import points, query
from lociframe.session import table


def _r(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


#: Two event types as reference and alternative signal over the hours of a user.
_RA = "SELECT key, pos // 3600 % 24 AS pos, sum(CASE WHEN kind = (SELECT min(kind) FROM pt) THEN abs(v) ELSE 0 END) AS ref, sum(CASE WHEN kind = (SELECT max(kind) FROM pt) THEN abs(v) ELSE 0 END) AS alt FROM pt GROUP BY ALL"


def _ref_alt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir)
    kinds = rows.agg(F.min("kind").alias("a"), F.max("kind").alias("b"))
    both = rows.crossJoin(F.broadcast(kinds)).groupBy("key", (F.floor(F.col("pos") / 3600) % 24).alias("pos"))
    return both.agg(F.sum(F.when(F.col("kind") == F.col("a"), F.abs("v")).otherwise(0.0)).alias("ref"), F.sum(F.when(F.col("kind") == F.col("b"), F.abs("v")).otherwise(0.0)).alias("alt"))


@query(f"WITH x AS ({_RA}), q AS (SELECT key, count(*) AS n, quantile_cont(ref, 0.25) AS p, sum(ref) AS sr, sum(alt) AS sa FROM x GROUP BY key), s AS (SELECT x.*, (ref + p) / (sr + n * p) AS nr, (alt + p) / (sa + n * p) AS na FROM x JOIN q ON q.key = x.key), j AS (SELECT key, sum(CASE WHEN nr > 0 THEN nr * ln(nr / na) ELSE 0 END) / 2 + sum(CASE WHEN na > 0 THEN na * ln(na / nr) ELSE 0 END) / 2 AS js FROM s WHERE nr > 0 AND na > 0 GROUP BY key) SELECT x.key, round(sum(alt) - sum(ref), 5) AS \"SAD\", round(sum(log2(alt + 1) - log2(ref + 1)), 5) AS \"logSAD\", round(sum(sqrt(alt) - sqrt(ref)), 5) AS \"sqrtSAD\", round(arg_max(alt - ref, abs(alt - ref)), 5) AS \"SAX\", round(sum(abs(alt - ref)), 5) AS \"D1\", round(sqrt(sum(pow(alt - ref, 2))), 5) AS \"D2\", round(sqrt(sum(pow(log2(alt + 1) - log2(ref + 1), 2))), 5) AS \"logD2\", round(sum(ref), 5) AS \"REF\", round(sum(alt), 5) AS \"ALT\" FROM x GROUP BY x.key", "pt")
def effect_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = ["SAD", "logSAD", "sqrtSAD", "SAX", "D1", "D2", "logD2", "REF", "ALT"]
    return sc.effect_scores(_ref_alt(spark, sf_dir), ["key"], stats=stats).select("key", *[F.round(s, 5).alias(s) for s in stats])


@query(f"WITH x AS ({_RA}), q AS (SELECT key, count(*) AS n, sum(ref) AS sr, sum(alt) AS sa FROM x GROUP BY key), s AS (SELECT x.*, (ref + 2.5) / (sr + n * 2.5) AS nr, (alt + 2.5) / (sa + n * 2.5) AS na FROM x JOIN q ON q.key = x.key) SELECT key, round(log2(sum(alt) + 1) - log2(sum(ref) + 1), 5) AS \"logSED\", round(sqrt(sum(pow(na - nr, 2))), 5) AS \"nD2\", round(max(abs(na - nr)), 5) AS \"nDi\", round((sum(nr * ln(nr / na)) + sum(na * ln(na / nr))) / 2, 5) AS \"JS\" FROM s GROUP BY key", "pt")
def gene_effect_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = ["logSED", "nD2", "nDi", "JS"]
    return sc.gene_scores(_ref_alt(spark, sf_dir).withColumn("pseudo", F.lit(2.5)), ["key"], stats=stats).select("key", *[F.round(s, 5).alias(s) for s in stats])


@query(f"WITH x AS ({_RA}) SELECT key, round(sum(alt) - sum(ref), 5) AS \"SED\", round(log2(sum(alt) + 1) - log2(sum(ref) + 1), 5) AS \"SEDR\", round(sum(log2(alt + 1) - log2(ref + 1)), 5) AS \"SER\", round(log2((sum(CASE WHEN pos >= 12 THEN alt ELSE 0 END) + 1) / (sum(CASE WHEN pos < 12 THEN alt ELSE 0 END) + 1)) - log2((sum(CASE WHEN pos >= 12 THEN ref ELSE 0 END) + 1) / (sum(CASE WHEN pos < 12 THEN ref ELSE 0 END) + 1)), 5) AS shift, round(sqrt(sum(pow(alt - ref, 2))), 5) AS \"SCD\", round(sqrt(sum(alt * alt)) - sqrt(sum(ref * ref)), 5) AS \"SSD\" FROM x GROUP BY key", "pt")
def ratio_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _ref_alt(spark, sf_dir)
    done = sc.ratio_scores(x, ["key"]).join(sc.proportion_shift(x, ["key"], F.col("pos") >= 12), "key").join(sc.map_difference(x, ["key"]), "key")
    return done.select("key", *[F.round(s, 5).alias(s) for s in ("SED", "SEDR", "SER", "shift", "SCD", "SSD")])


@query(f"WITH x AS ({_RA}), r AS (SELECT key, pos, (alt + 1) / (ref + 1) AS x FROM x), e AS (SELECT key, -1 AS pos, 1.0::DOUBLE AS x FROM r GROUP BY key UNION ALL SELECT key, pos, x FROM r UNION ALL SELECT key, 99, 1.0::DOUBLE FROM r GROUP BY key), s AS (SELECT a.key, a.pos, (SELECT avg(b.x) FROM e b WHERE b.key = a.key AND b.pos < a.pos) AS up, (SELECT avg(b.x) FROM e b WHERE b.key = a.key AND b.pos >= a.pos) AS dn FROM e a WHERE a.pos > -1) SELECT key, round(max(abs(log2(dn / up))), 5) AS \"COVR\" FROM s GROUP BY key", "pt")
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.coverage_ratio(_ref_alt(spark, sf_dir), ["key"], least=-1.0).select("key", F.round("COVR", 5).alias("COVR"))


@query("WITH k AS (SELECT unnest(range(1, 100)) / 1000.0::DOUBLE AS p UNION ALL SELECT unnest(range(10, 90)) / 100.0::DOUBLE UNION ALL SELECT unnest(range(900, 1000)) / 1000.0::DOUBLE), o AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS k FROM k), v AS (SELECT l_returnflag AS target, list(l_extendedprice ORDER BY l_extendedprice) AS a, count(*) AS n FROM lineitem GROUP BY 1) SELECT target, CAST(k AS INTEGER) AS k, p AS percentile, round(a[CAST(floor(p * (n - 1)) AS BIGINT) + 1] + (p * (n - 1) - floor(p * (n - 1))) * (a[least(CAST(floor(p * (n - 1)) AS BIGINT) + 2, n)] - a[CAST(floor(p * (n - 1)) AS BIGINT) + 1]), 6) AS value FROM v, o")
def percentile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("target"), F.col("l_extendedprice").alias("value"))
    return sc.percentile_grid(rows, ["target"]).select("target", "k", "percentile", F.round("value", 6).alias("value"))


@query("WITH k AS (SELECT unnest(range(1, 100)) / 1000.0::DOUBLE AS p UNION ALL SELECT unnest(range(10, 90)) / 100.0::DOUBLE UNION ALL SELECT unnest(range(900, 1000)) / 1000.0::DOUBLE), v AS (SELECT l_returnflag AS target, list(l_extendedprice ORDER BY l_extendedprice) AS a, count(*) AS n FROM lineitem GROUP BY 1), g AS (SELECT target, p, round(a[CAST(floor(p * (n - 1)) AS BIGINT) + 1] + (p * (n - 1) - floor(p * (n - 1))) * (a[least(CAST(floor(p * (n - 1)) AS BIGINT) + 2, n)] - a[CAST(floor(p * (n - 1)) AS BIGINT) + 1]), 6) AS value FROM v, k), l AS (SELECT target, list(value ORDER BY p) AS g, list(p ORDER BY p) AS ps FROM g GROUP BY target) SELECT l_orderkey AS o, l_linenumber AS l, l_extendedprice AS value, ps[least(len(list_filter(g, lambda x: x < l_extendedprice)) + 1, 279)] AS percentile FROM lineitem JOIN l ON target = l_returnflag")
def percentile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_returnflag").alias("target"), F.col("l_extendedprice").alias("value"))
    grid = sc.percentile_grid(rows, ["target"]).withColumn("value", F.round("value", 6))
    return sc.percentile_of(rows, grid, ["target"]).select("o", "l", "value", "percentile")


@query("WITH f AS (SELECT l_suppkey AS t, CASE WHEN l_suppkey % 3 = 0 THEN 'A' ELSE '-' END AS g, quantile_cont(l_extendedprice, 0.5) AS loc, (quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)) / 2 AS scale FROM lineitem GROUP BY ALL), m AS (SELECT g, quantile_cont(loc, 0.5) AS gl, quantile_cont(scale, 0.5) AS gs FROM f GROUP BY g), q AS (SELECT l_orderkey AS o, l_linenumber AS l, gl, gs, 0.5 + atan((l_extendedprice - loc) / scale) / pi() AS q FROM lineitem JOIN f ON t = l_suppkey JOIN m ON m.g = f.g) SELECT o, l, round(gl + gs * tan(pi() * (CASE WHEN q > 0.5 THEN q - 1e-5 ELSE q + 1e-5 END - 0.5)), 3) AS normalised FROM q")
def cauchy_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_suppkey").alias("t"), F.col("l_extendedprice").alias("value"))
    label = F.when(F.col("t") % 3 == 0, F.lit("A:x")).otherwise(F.lit("B:x"))
    fits = sc.fit_cauchy(rows, ["t"]).withColumn("g", sc.target_set(label, ["A"]))
    return sc.normalised_cauchy(rows, fits, ["t"], "g").select("o", "l", F.round("normalised", 3).alias("normalised"))


@query("SELECT l_orderkey AS o, l_suppkey % 7 AS t, round((avg(l_quantity) * 2 + avg(l_tax)) / 3, 6) AS value FROM (SELECT l_orderkey, l_suppkey, l_quantity, l_tax FROM lineitem) GROUP BY ALL")
def ensemble_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o"), (F.col("l_suppkey") % 7).alias("t")).agg(F.avg("l_quantity").alias("a"), F.avg("l_tax").alias("b"))
    parts = [cells.select("o", "t", F.col(c).alias("value")) for c in ("a", "a", "b")]
    return sc.ensemble(parts, ["o", "t"]).select("o", "t", F.round("value", 6).alias("value"))


@query("WITH n AS (SELECT vec_id, embedding, label, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings), r AS (SELECT a.vec_id AS snp_id, b.label AS target_id, b.vec_id AS partner, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / (a.norm * b.norm) AS r FROM n a JOIN n b ON a.vec_id <> b.vec_id) SELECT snp_id, CAST(target_id AS INTEGER) AS target_id, round(sum(r * (partner % 10)), 5) AS score FROM r WHERE r > 0.2 GROUP BY ALL")
def ld_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    ld = graph.cosine_pairs(rows, "vec_id", "embedding", 0.2)
    values = rows.select(F.col("vec_id").alias("snp_id"), F.col("label").alias("target_id"), (F.col("vec_id") % 10).alias("value"))
    done = sc.ld_weighted(ld.select(F.col("a").alias("snp_id"), F.col("b").alias("partner"), F.col("cosine").alias("r")), values)
    return done.select("snp_id", "target_id", F.round("score", 5).alias("score"))


@query("SELECT l_suppkey AS key, CASE WHEN l_returnflag = 'R' THEN 'N' ELSE l_returnflag END AS merged_id, round(sum(l_quantity), 6) AS value FROM lineitem GROUP BY ALL")
def strand_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_returnflag").alias("target_id"), F.col("l_quantity").alias("value"))
    targets = rows.select("target_id").distinct().withColumn("strand_pair", F.when(F.col("target_id") == "R", "N").when(F.col("target_id") == "N", "R"))
    return sc.strand_collapsed(rows, sc.merged_targets(targets), ["key"]).select("key", "merged_id", F.round("value", 6).alias("value"))


@query("WITH x AS (SELECT l_orderkey AS o, l_returnflag AS t, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), g AS (SELECT o % 1000 AS gene, t, avg(v) AS v FROM x GROUP BY ALL), p AS (SELECT quantile_cont(q, 0.5) AS p FROM (SELECT t, quantile_cont(v, 0.25) AS q FROM g GROUP BY t)) SELECT x.o, x.t, round(x.v / (g.v + p), 6) AS ratio FROM x JOIN g ON g.gene = x.o % 1000 AND g.t = x.t, p")
def exon_gene_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    exons = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_returnflag").alias("target_id")).agg(F.sum("l_quantity").alias("value")).withColumn("gene_id", F.col("o") % 1000)
    genes = exons.groupBy("gene_id", "target_id").agg(F.avg("value").alias("value"))
    return sc.exon_gene_ratio(exons, genes).select("o", F.col("target_id").alias("t"), F.round("ratio", 6).alias("ratio"))


@query("WITH t AS (SELECT l_suppkey AS key, log2(l_quantity + 1) AS y, log2(l_extendedprice + 1) AS p FROM lineitem) SELECT key, round(corr(y, p), 6) AS pearsonr FROM t GROUP BY key")
def within_gene_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "key")
    return sc.within_group_log_pearson(rows, ["key"], "l_quantity", "l_extendedprice").select("key", *_r("pearsonr"))


@query("SELECT l_orderkey AS o, l_linenumber AS l, round(l_quantity - avg(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS value FROM lineitem")
def saturation_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_quantity").alias("value"))
    return sc.centred_by_nucleotide(rows, ["o"]).select("o", "l", F.round("value", 6).alias("value"))


@query("WITH t AS (SELECT l_orderkey AS o, l_linenumber AS l, l_quantity AS x, l_returnflag = 'N' AS rooted FROM lineitem), u AS (SELECT *, CASE WHEN x > 20 THEN 19 + pow(x - 19, 2) ELSE x END AS y FROM t) SELECT o, l, round((CASE WHEN rooted THEN -1 + pow(y + 1, 4.0 / 3) ELSE y END) / 2, 6) AS newer, round((CASE WHEN (CASE WHEN x / 2 > 20 THEN 20 + pow(x / 2 - 20, 2) ELSE x / 2 END) IS NULL THEN NULL WHEN rooted THEN pow(CASE WHEN x / 2 > 20 THEN 20 + pow(x / 2 - 20, 2) ELSE x / 2 END, 4.0 / 3) ELSE CASE WHEN x / 2 > 20 THEN 20 + pow(x / 2 - 20, 2) ELSE x / 2 END END) * 2, 6) AS older, floor(x * 0.37 * 10) / 10 AS cut FROM u")
def untransform(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, rooted = F.col("l_quantity"), F.col("l_returnflag") == "N"
    newer = tf.untransform(x, F.lit(20.0), rooted, F.lit(2.0))
    older = tf.untransform_older(x, F.lit(20.0), rooted, F.lit(2.0))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.round(newer, 6).alias("newer"), F.round(older, 6).alias("older"), tf.truncated(x * 0.37, 1).alias("cut"))
