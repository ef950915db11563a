"""Sequence functions on text, whose letters a fixed rule turns into nucleotides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.functions import sequence as sq
from lociframe.plans.catalogue import query
from lociframe.session import table

#: Letters to nucleotides: the whole text, lower-cased, other characters dropped.
_FROM, _TO = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTNN"
_SQL = f"translate(regexp_replace(lower(c_name || '/' || c_mktsegment || '/' || c_name || c_mktsegment), '[^a-z]', '', 'g'), '{_FROM}', '{_TO}')"
_SEQ = f"SELECT c_custkey AS id, {_SQL} AS s FROM customer"
_HOP = 'SELECT CAST(doc_id AS BIGINT) AS id, translate(regexp_replace(lower(text), \'[^a-z]\', \'\', \'g\'), \'' + _FROM + "', '" + _TO + "') AS s FROM documents"


def _seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    whole = F.concat_ws("/", F.col("c_name"), F.col("c_mktsegment"), F.concat("c_name", "c_mktsegment"))
    return c.select(F.col("c_custkey").alias("id"), F.translate(F.regexp_replace(F.lower(whole), "[^a-z]", ""), _FROM, _TO).alias("s"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), _FROM, _TO).alias("s"))


@query(f"WITH t AS ({_HOP}) SELECT id, md5(reverse(translate(s, 'ACGT', 'TGCA'))) AS rc, length(s) AS n FROM t")
def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("id", F.md5(sq.reverse_complement(F.col("s"))).alias("rc"), F.length("s").cast("bigint").alias("n"))


@query(f"WITH t AS ({_SEQ}) SELECT id, left(left(s, 3) || 'AG' || substr(s, 4), length(s)) AS inserted, left(s, 2) || substr(s, 6) || repeat('N', 3) AS deleted, left(s, 4) || 'T' || substr(s, 6) AS replaced, 'NN' || left(s, length(s) - 2) AS right2, substr(s, 3) || 'NN' AS left2, substr(s, 6, 1) AS letter, s[(length(s) - 11) // 2 + 1:(length(s) - 11) // 2 + 11] AS middle FROM t")
def sequence_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    return _seqs(spark, sf_dir).select(
        "id", sq.inserted(s, 3, F.lit("AG")).alias("inserted"), sq.deleted(s, 2, 3).alias("deleted"), sq.replaced(s, 4, F.lit("T")).alias("replaced"),
        sq.shifted(s, 2).alias("right2"), sq.shifted(s, -2).alias("left2"), sq.letter_at(s, 5).alias("letter"), sq.fitted(s, 11).alias("middle"),
    )


@query(f"WITH t AS ({_SEQ}), k AS (SELECT substr(s, i, 3) AS k FROM (SELECT s, unnest(range(1, length(s) - 1)) AS i FROM t)) SELECT least(k, reverse(translate(k, 'ACGT', 'TGCA'))) AS kmer, CAST(count(*) AS BIGINT) AS n FROM k WHERE NOT contains(k, 'N') GROUP BY 1")
def kmer_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.kmers(_seqs(spark, sf_dir), "s", 3, [])


@query(f"WITH t AS ({_HOP}), c AS (SELECT sum(length(s) - length(replace(s, 'A', ''))) AS a, sum(length(s) - length(replace(s, 'C', ''))) AS c, sum(length(s) - length(replace(s, 'G', ''))) AS g, sum(length(s) - length(replace(s, 'T', ''))) AS t FROM t) SELECT nt, round((n + 1) / (a + c + g + t + 4), 8) AS freq FROM c, LATERAL (VALUES ('A', a), ('C', c), ('G', g), ('T', t)) v(nt, n)")
def nt_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.nucleotide_frequencies(_docs(spark, sf_dir), "s").select("nt", F.round("freq", 8).alias("freq"))


@query(f"WITH t AS ({_SEQ}), p AS (SELECT id, s, unnest(range(0, length(s))) AS pos FROM t) SELECT id, CAST(pos AS INTEGER) AS pos, nt, left(s, pos) || nt || substr(s, pos + 2) AS s FROM p, (VALUES ('A'), ('C'), ('G'), ('T')) v(nt) WHERE substr(s, pos + 1, 1) <> nt")
def satmut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.saturation(_seqs(spark, sf_dir), "s", ["id"])


_PWM = f"WITH t AS ({_SEQ}), e AS (SELECT id % 5 AS motif, unnest(range(0, length(s))) AS pos, s FROM t), c AS (SELECT motif, pos, count(*) AS n, sum(CASE substr(s, pos + 1, 1) WHEN 'A' THEN 1.0::DOUBLE WHEN 'N' THEN 0.25 ELSE 0 END) AS a, sum(CASE substr(s, pos + 1, 1) WHEN 'C' THEN 1.0::DOUBLE WHEN 'N' THEN 0.25 ELSE 0 END) AS c, sum(CASE substr(s, pos + 1, 1) WHEN 'G' THEN 1.0::DOUBLE WHEN 'N' THEN 0.25 ELSE 0 END) AS g, sum(CASE substr(s, pos + 1, 1) WHEN 'T' THEN 1.0::DOUBLE WHEN 'N' THEN 0.25 ELSE 0 END) AS t FROM e GROUP BY ALL), w AS (SELECT motif, pos, nt, (x + 1) / (n + 4) AS freq FROM c, LATERAL (VALUES ('A', a), ('C', c), ('G', g), ('T', t)) v(nt, x))"


@query(f"{_PWM} SELECT motif, CAST(pos AS INTEGER) AS pos, nt, round(freq, 8) AS freq FROM w")
def pwm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _seqs(spark, sf_dir).select((F.col("id") % 5).alias("motif"), "s")
    return sq.position_weights(rows, "s", ["motif"]).select("motif", "pos", "nt", F.round("freq", 8).alias("freq"))


@query(f"{_PWM} SELECT motif, round(sum(freq * log2(freq + 1e-9) - CASE WHEN nt IN ('C', 'G') THEN 0.415 * log2(0.415) ELSE 0.585 * log2(0.585) END), 6) AS bits FROM w GROUP BY motif")
def pwm_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _seqs(spark, sf_dir).select((F.col("id") % 5).alias("motif"), "s")
    return sq.information(sq.position_weights(rows, "s", ["motif"]), ["motif"]).select("motif", F.round("bits", 6).alias("bits"))


@query(f"WITH t AS ({_SEQ}) SELECT id, list_aggregate(list_transform(string_split(s, ''), lambda x: CASE x WHEN 'A' THEN '0' WHEN 'C' THEN '1' WHEN 'G' THEN '2' WHEN 'T' THEN '3' ELSE '4' END), 'string_agg', '') AS idx, s AS again, length(replace(s, 'N', ''))::DOUBLE AS hot FROM t")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = sq.one_hot(F.col("s"))
    total = F.aggregate(F.flatten(hot), F.lit(0.0), lambda a, x: a + x)
    return _seqs(spark, sf_dir).select("id", F.array_join(sq.indexed(F.col("s")).cast("array<string>"), "").alias("idx"), sq.from_one_hot(hot).alias("again"), total.alias("hot"))


@query("SELECT l_orderkey AS o, l_linenumber AS l, CAST(l_partkey % 40 + l_suppkey % 7 + l_linenumber AS BIGINT) AS n FROM lineitem")
def cigar_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    cigar = F.concat((F.col("l_partkey") % 40).cast("string"), F.lit("M2I"), (F.col("l_suppkey") % 7).cast("string"), F.lit("D3S"), F.col("l_linenumber").cast("string"), F.lit("="))
    return t.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), sq.cigar_length(cigar).alias("n"))


@query("SELECT c_custkey AS id, CASE WHEN length(c_mktsegment) > 5 THEN left(c_mktsegment, 5) || '*' ELSE c_mktsegment END AS capped, 'GENE' || c_custkey AS bare, c_mktsegment AS protein FROM customer")
def labels_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), sq.capped(F.col("c_mktsegment")).alias("capped"), sq.without_version(F.concat(F.lit("GENE"), F.col("c_custkey").cast("string"), F.lit(".12"))).alias("bare"), sq.leading_parenthesis(F.concat(F.lit("("), F.col("c_mktsegment"), F.lit(")_1.02"))).alias("protein"))


@query("WITH t AS (SELECT c_custkey AS id, regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g') AS s FROM customer) SELECT id, repeat('N', 4) || left(s, 6) AS head, right(s, 3) || repeat('N', 5) AS tail FROM t WHERE length(s) >= 6")
def fetch_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.regexp_replace("c_name", "[^A-Za-z0-9]", "").alias("s")).where(F.length("s") >= 6)
    n = F.length("s")
    return t.select("id", sq.window(F.col("s"), F.lit(-4), F.lit(6)).alias("head"), sq.window(F.col("s"), n - 3, n + 5).alias("tail"))
