"""Splits, samples, sets, graphs, pair tables and attribute parsing on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.checkpoint import cut
from lociframe.operators import alignments as al
from lociframe.operators import contacts as ct
from lociframe.operators import graph
from lociframe.operators import models as md
from lociframe.operators import splits as sp
from lociframe.plans.catalogue import intervals, points, query
from lociframe.session import table
from lociframe.sources import genomic


@query("SELECT o_orderkey AS o, CASE WHEN c_nationkey IN (1, 2, 3) THEN 'test' WHEN c_nationkey IN (3, 4, 5) THEN 'valid' ELSE 'train' END AS split, 'fold' || CAST((o_custkey * 2654435761 % 4294967296) % 8 AS VARCHAR) AS fold FROM orders JOIN customer ON c_custkey = o_custkey")
def split_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("o_orderkey").alias("o"), sp.by_key(F.col("c_nationkey"), [1, 2, 3], [3, 4, 5]).alias("split"), sp.folds(F.col("o_custkey"), 8).alias("fold"))


@query()
def quota_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = intervals(spark, sf_dir).groupBy(F.col("key").alias("id")).agg(F.sum(F.col("e") - F.col("s")).alias("size"))
    return sp.quota_split(spans, {"train": 0.8, "valid": 0.1, "test": 0.1})


@query("WITH seg AS (SELECT key, min(s) AS a, max(e) AS b, CASE WHEN key % 10 = 0 THEN 'test' WHEN key % 10 = 1 THEN 'valid' ELSE 'train' END AS split FROM iv GROUP BY key), p AS (SELECT DISTINCT struct_pack(o := okey, l := line, k := key, s := s, e := e) AS id, key AS ak, s, e, 1 + (key * 3 + line) % 50 AS bk FROM iv), x AS (SELECT p.id, g.split, sum(least(p.e, g.b) - greatest(p.s, g.a)) AS bp FROM p JOIN seg g ON g.key = p.ak AND p.s < g.b AND g.a < p.e GROUP BY ALL), y AS (SELECT p.id, g.split, sum(least(p.e, g.b) - greatest(p.s, g.a)) AS bp FROM p JOIN seg g ON g.key = p.bk AND p.s < g.b AND g.a < p.e GROUP BY ALL) SELECT x.split AS a_split, y.split AS b_split, CAST(count(*) AS BIGINT) AS pairs, CAST(sum(p.e - p.s) AS BIGINT) AS bases FROM x JOIN y ON y.id = x.id JOIN p ON p.id = x.id GROUP BY ALL", "iv")
def leakage_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals(spark, sf_dir)
    split = F.when(F.col("key") % 10 == 0, "test").when(F.col("key") % 10 == 1, "valid").otherwise("train")
    segments = rows.groupBy("key").agg(F.min("s").alias("start"), F.max("e").alias("end")).withColumn("split", split)
    whole = cut(rows.select("okey", "line", "key", "s", "e").distinct().withColumn("id", F.monotonically_increasing_id()))
    pairs = whole.select("id", F.col("key").alias("a_key"), F.col("s").alias("a_start"), F.col("e").alias("a_end"), (1 + (F.col("key") * 3 + F.col("line")) % 50).alias("b_key"), F.col("s").alias("b_start"), F.col("e").alias("b_end"))
    return sp.leakage(pairs, segments)


@query("WITH k AS (SELECT l_orderkey AS o, l_linenumber AS l, l_returnflag AS g, row_number() OVER (PARTITION BY l_returnflag ORDER BY (l_orderkey * 48271) % 65537, l_orderkey, l_linenumber) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) SELECT o, l, g FROM k WHERE k <= floor(n * 0.1)")
def sample_proportional(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_returnflag").alias("g"))
    return sp.sampled(rows, 0.1, F.struct((F.col("o") * 48271) % 65537, "o", "l"), ["g"])


@query("WITH s AS (SELECT l_suppkey AS g, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT g, sum(n) OVER (ORDER BY g DESC) - n AS b FROM s) SELECT g, CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN c ON g = l_suppkey WHERE b < 2000 GROUP BY g")
def sample_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"))
    return sp.within_budget(rows, 2000, "g", [F.desc("g")]).groupBy("g").agg(F.count("*").alias("n"))


@query("WITH m AS (SELECT l_suppkey AS k, max(l_extendedprice) AS m FROM lineitem GROUP BY 1), r AS (SELECT l_orderkey AS o, l_linenumber AS l, l_suppkey AS k, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS r, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) SELECT o, l, r.k, v, bool_or(v >= 0.666 * m) AS near_top, bool_or(r <= greatest(floor(n * 0.02), 1)) AS top FROM r JOIN m ON m.k = r.k WHERE v >= 0.666 * m OR r <= greatest(floor(n * 0.02), 1) GROUP BY ALL")
def top_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_suppkey").alias("k"), F.col("l_extendedprice").alias("v"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    a = sp.near_top(rows, ["k"], "v").select("o", "l", "k", "v", F.lit(True).alias("near_top"), F.lit(False).alias("top"))
    b = sp.top_share(rows, ["k"], "v", 0.02, "id").select("o", "l", "k", "v", F.lit(False).alias("near_top"), F.lit(True).alias("top"))
    return a.unionByName(b).groupBy("o", "l", "k", "v").agg(F.bool_or("near_top").alias("near_top"), F.bool_or("top").alias("top"))


@query("SELECT l_orderkey AS o, l_linenumber AS l, CAST((row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) - 1) // 256 AS BIGINT) AS shard FROM lineitem")
def shard_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.shards(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_orderkey", "l_linenumber"]).select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), "shard")


@query("WITH t AS (SELECT l_suppkey AS g, CAST(l_quantity AS BIGINT) + 50 * (l_partkey % 3) AS n FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC) AS k, max(n) OVER (PARTITION BY g) AS m FROM t) SELECT g, n FROM k WHERE n + k = m + 1")
def contiguous_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_quantity").cast("bigint") + 50 * (F.col("l_partkey") % 3)
    return sp.contiguous_tail(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), n.alias("n")).distinct(), "g", "n")


@query("WITH k AS (SELECT l_orderkey AS o, l_linenumber AS l, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS a, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) SELECT o, l FROM k WHERE a > 1 AND a <= n - 1")
def internal_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.inner_members(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber"], 1).select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"))


@query("SELECT o_custkey AS id FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey < 12")
def shared_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).intersect(table(spark, sf_dir, "customer").where("c_nationkey < 12").select("c_custkey"))


@query("WITH RECURSIVE e AS (SELECT DISTINCT 'o' || l_orderkey AS a, 'p' || l_partkey AS b FROM lineitem), d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(it, node, comp) AS (SELECT 0, a, a FROM (SELECT DISTINCT a FROM d) UNION ALL SELECT it + 1, node, min(comp) FROM (SELECT it, node, comp FROM r WHERE it < 40 UNION ALL SELECT it, d.b, comp FROM r JOIN d ON d.a = r.node WHERE it < 40) GROUP BY it, node) SELECT node, comp AS component FROM r WHERE it = 40")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("a"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("b"))
    nodes = rows.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return graph.labelled(nodes, rows)


@query("WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings), c AS (SELECT a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / (a.norm * b.norm) AS c FROM n a JOIN n b ON a.vec_id <> b.vec_id), k AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY round(c, 12) DESC, b) AS k FROM c) SELECT a, b, CAST(k AS INTEGER) AS rank, round(c, 6) AS cosine FROM k WHERE k <= 5")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 5).select("a", "b", "rank", F.round("cosine", 6).alias("cosine"))


_HOURS = "SELECT key, pos // 3600 % 24 AS i, sum(v) AS v FROM pt GROUP BY ALL"


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).groupBy("key", (F.floor(F.col("pos") / 3600) % 24).alias("i")).agg(F.sum("v").alias("v"))


@query(f"WITH h AS ({_HOURS}) SELECT a.key, a.i, b.i AS j, abs(a.i - b.i) AS apart, round((a.v + b.v) / 2, 6) AS mean, round(greatest(a.v, b.v), 6) AS most, round(a.v * b.v, 6) AS dot FROM h a JOIN h b ON b.key = a.key WHERE b.i - a.i >= 2", "pt")
def pairwise_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = ct.upper_triangle(ct.outer(_hours(spark, sf_dir), ["key"], "i", "v"), 2)
    return done.select("key", "i", "j", "apart", F.round("mean", 6).alias("mean"), F.round("max", 6).alias("most"), F.round("dot", 6).alias("dot"))


@query(f"WITH h AS ({_HOURS}), m AS (SELECT a.key, a.i, b.i AS j, a.v * b.v AS v FROM h a JOIN h b ON b.key = a.key), d AS (SELECT key, abs(i - j) AS d, avg(v) AS v FROM m GROUP BY ALL) SELECT m.key, m.i, m.j, round(m.v / nullif(d.v, 0), 4) AS v FROM m JOIN d ON d.key = m.key AND d.d = abs(m.i - m.j) WHERE m.i <= m.j", "pt")
def observed_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    square = ct.outer(_hours(spark, sf_dir), ["key"], "i", "v").select("key", "i", "j", F.col("dot").alias("value"))
    return ct.observed_over_expected(square, ["key"]).where("i <= j").select("key", "i", "j", F.round("value", 4).alias("v"))


@query("SELECT event_id AS id, json_extract_string(props, '$.k') AS k, 'g' || (event_id % 100) AS gene_id, CAST(event_id % 7 AS VARCHAR) AS exon FROM events")
def attr_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('gene_id "g'), (F.col("event_id") % 100).cast("string"), F.lit('"; exon_number "'), (F.col("event_id") % 7).cast("string"), F.lit('";'))
    attrs = genomic.attributes(text)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").alias("k"), attrs["gene_id"].alias("gene_id"), attrs["exon_number"].alias("exon"))


_EM = "WITH hits AS (SELECT DISTINCT okey AS r, key AS c, s AS p FROM iv), w0 AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY r) AS w FROM hits), v1 AS (SELECT w0.*, sum(w) OVER (PARTITION BY c, p) + 0.01 AS x FROM w0), u1 AS (SELECT r, c, p, w AS old, x / sum(x) OVER (PARTITION BY r) AS w FROM v1), d1 AS (SELECT avg(abs(w - old)) AS d FROM u1), w1 AS (SELECT r, c, p, w FROM u1), v2 AS (SELECT w1.*, sum(w) OVER (PARTITION BY c, p) + 0.01 AS x FROM w1), u2 AS (SELECT r, c, p, w AS old, x / sum(x) OVER (PARTITION BY r) AS w FROM v2), d2 AS (SELECT avg(abs(w - old)) AS d FROM u2), w2 AS (SELECT r, c, p, w FROM u2), v3 AS (SELECT w2.*, sum(w) OVER (PARTITION BY c, p) + 0.01 AS x FROM w2), u3 AS (SELECT r, c, p, w AS old, x / sum(x) OVER (PARTITION BY r) AS w FROM v3), d3 AS (SELECT avg(abs(w - old)) AS d FROM u3), w3 AS (SELECT r, c, p, w FROM u3), v4 AS (SELECT w3.*, sum(w) OVER (PARTITION BY c, p) + 0.01 AS x FROM w3), u4 AS (SELECT r, c, p, w AS old, x / sum(x) OVER (PARTITION BY r) AS w FROM v4), d4 AS (SELECT avg(abs(w - old)) AS d FROM u4), w4 AS (SELECT r, c, p, w FROM u4), pick AS (SELECT CASE WHEN (SELECT d FROM d1) < 0.05 THEN 1 WHEN (SELECT d FROM d2) < 0.05 THEN 2 WHEN (SELECT d FROM d3) < 0.05 THEN 3 ELSE 4 END AS k), al AS (SELECT 1 AS k, * FROM w1 UNION ALL SELECT 2 AS k, * FROM w2 UNION ALL SELECT 3 AS k, * FROM w3 UNION ALL SELECT 4 AS k, * FROM w4) SELECT r AS read_id, c AS chrom, p AS pos, round(w, 7) AS weight FROM al WHERE k = (SELECT k FROM pick)"


@query(_EM, "iv")
def em_allocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals(spark, sf_dir).select(F.col("okey").alias("read_id"), F.col("key").alias("chrom"), F.col("s").alias("pos")).distinct()
    return al.distribute_multi(rows, 4, 0.05).select("read_id", "chrom", "pos", F.round("weight", 7).alias("weight"))


def _ridge_sql() -> str:
    """The cubic ridge regression as SQL: normal equations, solved by elimination in a chain of steps."""
    sums = ", ".join([f"avg(pow(gc, {k})) AS m{k}" for k in range(7)] + [f"avg(pow(gc, {k}) * log2(v + 0.01)) AS y{k}" for k in range(4)])
    cells = ", ".join([f"m{i + j}{' + 0.01' if i == j and i else ''} AS a{i}{j}" for i in range(4) for j in range(4)] + [f"y{i} AS a{i}4" for i in range(4)] + ["y0"])
    steps, last = [], "e0"
    for k in range(4):
        made = ", ".join(f"a{i}{j} - a{i}{k} / a{k}{k} * a{k}{j} AS a{i}{j}" if i != k else f"a{i}{j}" for i in range(4) for j in range(5))
        steps.append(f"e{k + 1} AS (SELECT {made}, y0 FROM {last})")
        last = f"e{k + 1}"
    predicted = " + ".join(f"a{k}4 / a{k}{k} * pow(gc, {k})" for k in range(4))
    return f"WITH t AS (SELECT l_suppkey, avg(l_discount) AS gc, sum(l_quantity) AS v FROM lineitem GROUP BY 1), s AS (SELECT {sums} FROM t), e0 AS (SELECT {cells} FROM s), {', '.join(steps)} SELECT l_suppkey, round(v / pow(2, {predicted} - y0), 4) AS normalised FROM t, {last}"


@query(_ridge_sql())
def gc_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("gc"), F.sum("l_quantity").alias("coverage"))
    return al.gc_normalised(rows, "gc", "coverage").select("l_suppkey", F.round("normalised", 4).alias("normalised"))


@query("WITH d AS (SELECT key, pos // 600 AS pos, id % 2 AS strand, CAST(count(*) AS DOUBLE) AS n FROM pt GROUP BY ALL), p AS (SELECT b.pos - a.pos AS d, sum(a.n * b.n) AS x FROM d a JOIN d b ON b.key = a.key AND a.strand = 0 AND b.strand = 1 AND b.pos - a.pos BETWEEN 5 AND 40 GROUP BY ALL) SELECT d AS shift, round(x, 6) AS product FROM p", "pt")
def strand_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).groupBy("key", F.floor(F.col("pos") / 600).alias("pos"), (F.col("id") % 2).alias("strand")).agg(F.count("*").cast("double").alias("n"))
    return al.shift_products(rows.where("strand = 0"), rows.where("strand = 1"), 5, 40, "key").select("shift", F.round("product", 6).alias("product"))


@query()
def forest_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_returnflag") == "R").cast("double").alias("label"), "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return md.forest_auroc(rows, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "label", "id", folds=2, trees=5, depth=4)
