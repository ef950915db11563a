"""Interval algebra on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.operators import intervals as iv
from lociframe.operators import signal as sg
from lociframe.plans.catalogue import intervals, points, query
from lociframe.session import table


@query("WITH w AS (SELECT key, CAST(floor(s / 32.0) AS BIGINT) + unnest(range(0, CAST(floor((e - 1) / 32.0) AS BIGINT) - CAST(floor(s / 32.0) AS BIGINT) + 1)) AS bin, s, e, v FROM iv WHERE e > s) SELECT key, bin, round(sum(v * (least(e, (bin + 1) * 32) - greatest(s, bin * 32))), 2) AS total, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY key, bin", "iv")
def pool_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals(spark, sf_dir).where("e > s")
    return sg.pool_intervals(rows, 32, key="key", start="s", end="e", value="v").select("key", "bin", F.round("total", 2).alias("total"), "n")


@query("SELECT a.key, CAST(count(*) AS BIGINT) AS pairs, CAST(sum(least(a.e, b.e) - greatest(a.s, b.s)) AS BIGINT) AS shared FROM iv a JOIN iv b ON a.key = b.key AND a.s < b.e AND b.s < a.e AND a.okey < b.okey GROUP BY a.key", "iv")
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals(spark, sf_dir)
    a = rows.select("key", F.col("s").alias("a_start"), F.col("e").alias("a_end"), F.col("okey").alias("a_order"))
    b = rows.select("key", F.col("s").alias("b_start"), F.col("e").alias("b_end"), F.col("okey").alias("b_order"))
    met = iv.overlap_join(a, b, width=32).where("a_order < b_order")
    return met.groupBy("key").agg(F.count("*").alias("pairs"), F.sum("overlap").alias("shared"))


@query("WITH b AS (SELECT key, CAST(min(s) + 100 AS BIGINT) AS bs, CAST(min(s) + 400 AS BIGINT) AS be FROM iv GROUP BY key) SELECT iv.key, okey, line, greatest(s, bs) AS start, least(e, be) AS \"end\" FROM iv JOIN b ON iv.key = b.key AND s < be AND bs < e", "iv")
def overlap_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals(spark, sf_dir)
    kept = rows.groupBy("key").agg((F.min("s") + 100).alias("b_start"), (F.min("s") + 400).alias("b_end"))
    a = rows.select("key", "okey", "line", F.col("s").alias("a_start"), F.col("e").alias("a_end"))
    return iv.clip_to(a, kept, width=256).select("key", "okey", "line", "start", "end")


@query("SELECT w.key, w.win * 86400 AS start, pt.id FROM (SELECT DISTINCT key, pos // 86400 AS win FROM pt) w JOIN pt ON pt.key = w.key AND pos > w.win * 86400 + 21600 AND pos < w.win * 86400 + 86400 - 21600", "pt")
def containment_vision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir)
    windows = rows.select("key", (F.floor(F.col("pos") / 86400) * 86400).alias("start")).distinct().withColumn("end", F.col("start") + 86400)
    return iv.containment_join(windows, rows.select("key", "pos", "id"), vision=0.5, width=86400).select("key", "start", "id")


@query("WITH m AS (SELECT *, max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv), i AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT key, min(s) AS s, max(e) AS e, CAST(count(*) AS BIGINT) AS n FROM i GROUP BY key, g", "iv")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.merge(intervals(spark, sf_dir), "key", "s", "e").select("key", "s", "e", "n")


@query("WITH t AS (SELECT okey AS key, s, e FROM iv), m AS (SELECT *, max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM t), i AS (SELECT *, sum(CASE WHEN s < reach THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT key, min(s) AS s, max(e) AS e, CAST(count(*) AS BIGINT) AS n FROM i GROUP BY key, g", "iv")
def interval_merge_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals(spark, sf_dir).select(F.col("okey").alias("key"), "s", "e")
    return iv.merge(rows, "key", "s", "e", touching=False).select("key", "s", "e", "n")


@query("WITH d AS (SELECT okey AS key, unnest(range(s, e)) AS x FROM iv), span AS (SELECT okey AS key, min(s) - 10 AS a, max(e) + 10 AS b FROM iv GROUP BY okey), free AS (SELECT key, x FROM (SELECT key, unnest(range(a, b)) AS x FROM span) WHERE (key, x) NOT IN (SELECT key, x FROM d)), g AS (SELECT key, x, x - row_number() OVER (PARTITION BY key ORDER BY x) AS g FROM free) SELECT key, CAST(min(x) AS BIGINT) AS start, CAST(max(x) + 1 AS BIGINT) AS \"end\" FROM g GROUP BY key, g", "iv")
def interval_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals(spark, sf_dir).select(F.col("okey").alias("key"), F.col("s").alias("start"), F.col("e").alias("end"))
    spans = rows.groupBy("key").agg((F.min("start") - 10).alias("start"), (F.max("end") + 10).alias("end"))
    return iv.subtract(spans, rows)


@query("WITH c AS (SELECT o_custkey AS key, CAST(min(CAST(o_orderdate AS DATE)) - DATE '1992-01-01' AS BIGINT) AS s, CAST(max(CAST(o_orderdate AS DATE)) - DATE '1992-01-01' AS BIGINT) AS e FROM orders GROUP BY 1), t AS (SELECT key, unnest(range(s, e - 90 + 1, 60)) AS start, true AS inclusive FROM c WHERE e - 90 >= s UNION ALL SELECT key, unnest(range(s, e - 90, 60)), false FROM c WHERE e - 90 > s) SELECT key, start, start + 90 AS \"end\", inclusive FROM t")
def tile_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.expr("cast(datediff(o_orderdate, DATE'1992-01-01') as bigint)")
    spans = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.min(day).alias("start"), F.max(day).alias("end"))
    both = [iv.tile(spans, 90, 60, inclusive=x).withColumn("inclusive", F.lit(x)) for x in (True, False)]
    return both[0].unionByName(both[1])


@query("WITH c AS (SELECT key, CAST(min(s) AS BIGINT) AS s, CAST(max(e) AS BIGINT) AS e FROM iv GROUP BY key) SELECT key, s, e FROM c", "iv")
def rejoin_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = intervals(spark, sf_dir).groupBy("key").agg(F.min("s").alias("start"), F.max("e").alias("end"))
    pieces = spans.withColumn("cut", F.explode(F.sequence("start", F.col("end") - 1, F.lit(7).cast("bigint"))))
    pieces = pieces.select("key", F.col("cut").alias("start"), F.least(F.col("cut") + 7, F.col("end")).alias("end"))
    return iv.rejoin(pieces).select("key", F.col("start").alias("s"), F.col("end").alias("e"))


@query("WITH c AS (SELECT key, CAST(min(s) AS BIGINT) AS s, CAST(max(e) AS BIGINT) AS e FROM iv GROUP BY key), r AS (SELECT key, s, e FROM c UNION ALL SELECT key, CASE WHEN h.x = 0 THEN s ELSE s + (e - s) // 2 END, CASE WHEN h.x = 0 THEN s + (e - s) // 2 ELSE e END FROM r, (VALUES (0), (1)) h(x) WHERE e - s > 300) SELECT key, s, e FROM r WHERE e - s <= 300", "iv")
def break_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = intervals(spark, sf_dir).groupBy("key").agg(F.min("s").alias("start"), F.max("e").alias("end"))
    return iv.break_large(spans, 300).select("key", F.col("start").alias("s"), F.col("end").alias("e"))


@query("WITH t AS (SELECT l_partkey AS part, CAST(CAST(l_shipdate AS DATE) - DATE '1992-01-01' AS BIGINT) AS s, CAST(CAST(l_shipdate AS DATE) - DATE '1992-01-01' AS BIGINT) + CAST(floor(l_quantity) AS BIGINT) AS e, l_orderkey AS okey FROM lineitem) SELECT part, okey, s, e FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.part = a.part AND b.okey <> a.okey AND a.s < b.e AND b.s < a.e)")
def anti_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.without_overlaps(intervals(spark, sf_dir, "l_partkey"), "key", "okey", "s", "e").select(F.col("key").alias("part"), "okey", "s", "e")


@query("WITH w AS (SELECT key, pos, pos // 3600 * 3600 AS start FROM pt), b AS (SELECT key, CAST(round_even((pos % 3600) / 128.0, 0) AS BIGINT) AS f, CAST(round_even((pos % 3600 + 140) / 128.0, 0) AS BIGINT) AS l, (pos % 3600) // 128 AS f2, CAST(ceil((pos % 3600 + 140) / 128.0) AS BIGINT) AS l2 FROM w), t AS (SELECT key, unnest(range(f, l)) AS bin, 'majority' AS mode FROM b UNION ALL SELECT key, unnest(range(f2, l2)), 'any' FROM b) SELECT key, bin, mode, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY ALL", "pt")
def majority_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).select("key", (F.col("pos") % 3600).alias("at"))
    both = [rows.select("key", F.explode(iv.bins_touched(F.col("at"), F.col("at") + 140, 128, m)).alias("bin"), F.lit("majority" if m else "any").alias("mode")) for m in (True, False)]
    return both[0].unionByName(both[1]).groupBy("key", "bin", "mode").agg(F.count("*").alias("n"))


@query("WITH w AS (SELECT DISTINCT key, s // 128 * 128 AS start FROM iv), m AS (SELECT w.key, start, greatest(s - start, 0) AS a, least(e, start + 128) - start AS b FROM w JOIN iv ON iv.key = w.key AND s < start + 128 AND start < e), r AS (SELECT key, start, a // 16 + CASE WHEN 1 - (a % 16) / 16.0 < 0.1 THEN 1 ELSE 0 END AS f, CAST(ceil(b / 16.0) AS BIGINT) - CASE WHEN b % 16 <> 0 AND (b % 16) / 16.0 < 0.1 THEN 1 ELSE 0 END AS l FROM m) SELECT DISTINCT key, start, unnest(range(f, l)) AS bin FROM r WHERE l > f", "iv")
def unmap_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals(spark, sf_dir)
    windows = rows.select("key", (F.floor(F.col("s") / 128) * 128).alias("start")).distinct().withColumn("end", F.col("start") + 128)
    return iv.masked_bins(windows, rows.select("key", F.col("s").alias("r_start"), F.col("e").alias("r_end")), 16, width=128).select("key", "start", "bin")


@query("WITH g AS (SELECT key, pos, pos - lag(pos) OVER (PARTITION BY key ORDER BY pos) AS gap FROM pt), c AS (SELECT key, pos, sum(CASE WHEN gap < 7200 THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY pos RANGE UNBOUNDED PRECEDING) AS cluster FROM g) SELECT key, CAST(cluster AS BIGINT) AS cluster, min(pos) AS first, max(pos) AS last, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY key, cluster", "pt")
def cluster_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = iv.chain(points(spark, sf_dir), 7200)
    return done.groupBy("key", F.col("cluster").cast("bigint").alias("cluster")).agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n"))


@query("WITH f AS (SELECT key, min(pos) AS first FROM pt GROUP BY key UNION ALL SELECT f.key, (SELECT min(pos) FROM pt WHERE pt.key = f.key AND pt.pos >= f.first + 86400) FROM f WHERE f.first IS NOT NULL), n AS (SELECT key, first, lead(first) OVER (PARTITION BY key ORDER BY first) AS next FROM f WHERE first IS NOT NULL) SELECT n.key, n.first, CAST(count(*) AS BIGINT) AS n FROM n JOIN pt ON pt.key = n.key AND pos >= n.first AND (next IS NULL OR pos < next) GROUP BY n.key, n.first", "pt")
def cluster_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.greedy(points(spark, sf_dir), 86400)


@query("WITH o AS (SELECT key, pos, row_number() OVER (PARTITION BY key ORDER BY pos) AS k FROM pt), r AS (SELECT key, k, 1 AS c, CAST(pos AS HUGEINT) AS total, CAST(1 AS BIGINT) AS n FROM o WHERE k = 1 UNION ALL SELECT o.key, o.k, CASE WHEN near THEN c ELSE c + 1 END, CAST(CASE WHEN near THEN total + pos ELSE pos END AS HUGEINT), CASE WHEN near THEN n + 1 ELSE 1 END FROM (SELECT o.key, o.k, pos, r.c, r.total, r.n, pos - total::DOUBLE / n <= 7200 AS near FROM r JOIN o ON o.key = r.key AND o.k = r.k + 1) o), l AS (SELECT key, c, max(n) AS n, arg_max(total, n) AS total FROM r GROUP BY ALL) SELECT key, round(total::DOUBLE / n, 6) AS mean, n FROM l", "pt")
def cluster_running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.running_mean_clusters(points(spark, sf_dir), 7200).select("key", F.round("mean", 6).alias("mean"), "n")


@query("WITH o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos, id) AS k FROM pt), l AS (SELECT key, pos, id, k - row_number() OVER (PARTITION BY key ORDER BY pos, id) AS g FROM o WHERE v < 50) SELECT key, min(pos) AS first, max(pos) AS last, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY key, g HAVING count(*) >= 2", "pt")
def run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).withColumn("at", F.struct("pos", "id"))
    return iv.runs(rows, F.col("v") < 50, "key", "at", 2).select("key", F.col("first.pos").alias("first"), F.col("last.pos").alias("last"), "n")


@query("WITH t AS (SELECT okey, s, e, CAST(line AS DOUBLE) AS v FROM iv), b AS (SELECT okey, s AS x FROM t UNION SELECT okey, e FROM t), p AS (SELECT okey, x AS start, lead(x) OVER (PARTITION BY okey ORDER BY x) AS stop FROM b) SELECT p.okey AS key, p.start, p.stop AS \"end\", CAST(count(*) AS BIGINT) AS depth, round(avg(v), 6) AS mean FROM p JOIN t ON t.okey = p.okey AND t.s <= p.start AND t.e >= p.stop GROUP BY ALL", "iv")
def bedgraph_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals(spark, sf_dir).select(F.col("okey").alias("key"), F.col("s").alias("start"), F.col("e").alias("end"), F.col("line").cast("double").alias("value"))
    return iv.disjoin(rows).select("key", "start", "end", "depth", F.round("mean", 6).alias("mean"))


@query("WITH g AS (SELECT okey AS key, CASE WHEN e - s < 24 THEN (s + e) // 2 - 12 ELSE s END AS s, CASE WHEN e - s < 24 THEN (s + e) // 2 + 12 ELSE e END AS e FROM iv), m AS (SELECT *, max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g), i AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m), j AS (SELECT key, min(s) AS s, max(e) AS e FROM i GROUP BY key, g), z AS (SELECT key, (s + e) // 2 AS mid, CAST(ceil((e - s) / 8.0) AS BIGINT) * 8 AS size FROM j) SELECT key, greatest(mid - size // 2, 0) AS start, greatest(mid - size // 2, 0) + size AS \"end\" FROM z", "iv")
def curate_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals(spark, sf_dir).select(F.col("okey").alias("key"), F.col("s").alias("start"), F.col("e").alias("end"))
    return iv.curated_peaks(rows, 8, 8)


@query("SELECT okey, line, (s + e) // 2 - 16 AS start, (s + e) // 2 + 16 AS \"end\" FROM iv", "iv")
def recentre_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last = iv.recentre(F.col("s"), F.col("e"), 32)
    return intervals(spark, sf_dir).select("okey", "line", first.alias("start"), last.alias("end"))


@query("WITH k AS (SELECT *, row_number() OVER (PARTITION BY key, s // 16 * 16 ORDER BY okey, line) AS k FROM iv) SELECT key, s // 16 * 16 AS start, okey, line FROM k WHERE k = 1", "iv")
def bedgraph_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals(spark, sf_dir).select("key", (F.floor(F.col("s") / 16) * 16).alias("start"), "okey", "line")
    return iv.grid_first(rows, ["okey", "line"])


@query("WITH n AS (SELECT key, max(e) AS length FROM iv GROUP BY key) SELECT iv.key, okey, line FROM iv JOIN n ON n.key = iv.key WHERE s >= 1200 AND e <= length - 100", "iv")
def far_from_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals(spark, sf_dir)
    return iv.far_from_ends(rows, rows.groupBy("key").agg(F.max("e").alias("length")), 100, "key", "s", "e").where("s >= 1200").select("key", "okey", "line")


@query("WITH n AS (SELECT key, max(e) AS length FROM iv GROUP BY key), o AS (SELECT key, length, sum(length) OVER (ORDER BY key) - length AS ofs FROM n) SELECT iv.okey, iv.line, CAST(iv.s + o.ofs AS BIGINT) AS place FROM iv JOIN o ON o.key = iv.key", "iv")
def genome_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals(spark, sf_dir)
    return rows.join(iv.offsets(rows.groupBy("key").agg(F.max("e").alias("length"))), "key").select("okey", "line", (F.col("s") + F.col("offset")).alias("place"))
