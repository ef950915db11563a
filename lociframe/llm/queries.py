"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm import ann, bpe, exact_dedup, html_text, lang_id, mixing, simhash, token_counts, url_filter, warc
from lociframe.llm.common import fields

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def sql(name: str, text: str) -> None:
    ORACLES[name] = text


#: The rules of the URL query. Hosts and paths as given; longer rules win.
URL_RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))

#: Patterns for URLs that no rule above fits.
URL_PATTERNS = ("||cheap-pills.", "||spam-farm.", "||casino.", "||casino-win.", "||free-bets.", "||ads-track.", "/casino/", "/adserver/", "/banner^ad^", "@@/casino/rules|")


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.Rule(f"||{r}", action, 2) for r, action in URL_RULES] + [url_filter.parse(p) for p in URL_PATTERNS]
    done = url_filter.judge(fields(read(spark, sf_dir, "pages"), "page_id", "url"), rules)
    return done.select("page_id", "host", "path", F.when(F.col("rule_priority") == 2, F.col("rule")).alias("rule"), F.col("action").alias("verdict"))


sql(
    "op1_url_filter",
    """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN split_part(split_part(substr(url, strpos(url, '://') + 3), '#', 1), '?', 1) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(split_part(rest, '/', 1)) + 1) AS path FROM cut
), rules(rh, rp, act) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), fits AS (
  SELECT page_id, rh || rp AS rule, act, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, rh || rp DESC) AS k
  FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT p.page_id, p.host, p.path, f.rule,
  CASE WHEN f.rule IS NOT NULL THEN f.act
       WHEN p.host <> '' AND (regexp_matches(p.host || p.path, '^([^/]*[.])?(cheap-pills|spam-farm|casino|casino-win|free-bets|ads-track)[.]') OR contains(p.host || p.path, '/casino/') OR contains(p.host || p.path, '/adserver/') OR regexp_matches(p.host || p.path, '/banner([^a-zA-Z0-9_.%-]|$)ad([^a-zA-Z0-9_.%-]|$)')) AND NOT ends_with(p.host || p.path, '/casino/rules') THEN 'block'
       ELSE 'allow' END AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.k = 1
""",
)


@query
def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(fields(read(spark, sf_dir, "embeddings"), "vec_id", "embedding"), F.col("vec_id") % 50 == 0)


@query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(fields(read(spark, sf_dir, "documents"), "doc_id", "text"), digest="text_sha256")


sql(
    "op5_exact_dedup",
    """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS size, sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256 FROM documents
), k AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w AS place
  FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY size DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM k
""",
)

@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive_and_read(spark, fields(read(spark, sf_dir, "pages"), "page_id", "url", "html"))
    digest = warc.verified(F.col("payload"), F.col("digest"))
    return back.select(warc.row_id("record_id").alias("page_id"), F.col("length").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", warc.row_id("refers_to").alias("refers_to"))


sql(
    "op2_warc",
    """
WITH t AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), k AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM t
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN best END AS refers_to
FROM k
""",
)


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = simhash.near_groups(fields(read(spark, sf_dir, "documents"), "doc_id", "text"))
    return done.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Target weights of sources; those not named have 1.
SOURCE_WEIGHTS = {"src0": 6, "src1": 3, "src2": 3, "src3": 2, "src4": 2}


@query
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fields(read(spark, sf_dir, "documents"), "doc_id", "source")
    return mixing.mix(docs, SOURCE_WEIGHTS)[0].select("doc_id", "source", "block", "place", "slot", "released", "due")


sql(
    "op6_mix_sources",
    """
WITH RECURSIVE t AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS key, CASE source WHEN 'src0' THEN 6 WHEN 'src1' THEN 3 WHEN 'src2' THEN 3 WHEN 'src3' THEN 2 WHEN 'src4' THEN 2 ELSE 1 END AS w,
    row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), ''))) - 1 AS r FROM documents
), s AS (
  SELECT list(key ORDER BY key) AS keys, list(w ORDER BY key) AS ws, list(n ORDER BY key) AS ns FROM (SELECT key, any_value(w) AS w, (count(*) + 15) // 16 AS n FROM t GROUP BY key)
), run AS (  -- one slot at a time: what each source has had in this phase, what it has left, and who gets the slot
  SELECT CAST(-1 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS start, list_transform(ns, lambda x: CAST(0 AS BIGINT)) AS had, list_transform(ns, lambda x: CAST(x AS BIGINT)) AS lft, CAST(0 AS BIGINT) AS who, CAST(0 AS BIGINT) AS blk, CAST(0 AS BIGINT) AS released, CAST(0 AS BIGINT) AS due FROM s
  UNION ALL
  SELECT slot, CASE WHEN lft[who] = 1 THEN slot + 1 ELSE start END,
    CASE WHEN lft[who] = 1 THEN list_transform(had, lambda x: CAST(0 AS BIGINT)) ELSE list_transform(had, lambda x, i: CASE WHEN i = who THEN x + 1 ELSE x END) END,
    list_transform(lft, lambda x, i: CASE WHEN i = who THEN x - 1 ELSE x END), who,
    CAST(ns[who] - lft[who] AS BIGINT), start + had[who] * total // ws[who], start + CAST(ceil((had[who] + 1) * total / ws[who]) AS BIGINT)
  FROM (
    SELECT *, list_min(list_transform(list_filter(list_transform(ws, lambda x, i: CASE WHEN lft[i] > 0 AND had[i] * total // x <= slot - start THEN CAST(ceil((had[i] + 1) * total / x) AS BIGINT) * 10000 + i END), lambda x: x IS NOT NULL), lambda x: x)) % 10000 AS who
    FROM (SELECT run.slot + 1 AS slot, run.start, run.had, run.lft, s.ws, s.ns, list_sum(list_transform(s.ws, lambda x, i: CASE WHEN run.lft[i] > 0 THEN x ELSE 0 END)) AS total FROM run, s WHERE list_sum(run.lft) > 0)
  )
)
SELECT t.doc_id, t.source, CAST(r // 16 AS BIGINT) AS block, CAST(r % 16 AS INTEGER) AS place, run.slot, run.released, run.due
FROM t, s, run WHERE run.slot >= 0 AND s.keys[run.who] = t.key AND run.blk = r // 16
""",
)


@query
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fields(read(spark, sf_dir, "pages"), "page_id", "url", "html")
    done = html_text.extract(pages, weights=html_text.learn(pages))
    return done.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fields(read(spark, sf_dir, "documents"), "doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fields(read(spark, sf_dir, "documents"), "doc_id", "text")
    done = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded="decoded", packed=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def held_out(id: str = "doc_id") -> Column:
    """Every fourth document, whose language is never learned from."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@query
def op10_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fields(read(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    done = lang_id.identify(docs, learn=F.col("doc_id").isNotNull() & ~held_out())
    return done.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
