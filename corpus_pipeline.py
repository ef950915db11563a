"""The corpus pipeline: five stages over the documents table, each written as Parquet and read again by the next.

Language ID drops documents whose language is `und` (no text or no letter), exact dedup keeps one of equal texts, near
dedup one of each SimHash group, mixing orders what is left by Pfair slots of its sources, and BPE gives the ids. Each
stage works on all rows that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm import bpe, exact_dedup, lang_id, mixing, queries, simhash
from lociframe.llm.common import fresh_dir


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter. The field learns from those that are not held out and labels every text, but a text is
    `und` only where it has no letter: no language or score drops a document, so the field has no effect on which stay."""
    field = lang_id.fit(lang_id.sample(docs, "doc_id", "text", "lang", F.col("doc_id").isNotNull() & ~queries.held_out()))
    return lang_id.keep_known(docs, field)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts: the longest, then that of the smallest doc_id."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of texts that share five-word shingles to a similarity of 0.8 or more: that of the smallest
    doc_id."""
    return simhash.drop_similar(docs, words=5, similarity=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the files' order mixed to the target weights."""
    return mixing.in_mixed_order(docs, queries.SOURCE_WEIGHTS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, position, n_tokens, ids, and the digests of ids and decoded bytes. Rows come in any order:
    sorted by position (file and row of what the mix stored) they follow the mix."""
    name = F.col("_metadata.file_name")
    numbers = [F.regexp_extract(name, p, 1).try_cast("bigint") for p in (r"^part-(\d+)", r"-c(\d+)\.")]
    position = F.struct(numbers[0].alias("part"), numbers[1].alias("file"), F.col("_metadata.row_index").alias("row"))
    kept = docs.select("doc_id", "lang", "source", position.alias("position"), "text")
    done = bpe.encode(kept, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded="decoded", packed=True)
    digests = {"ids_sha256": F.sha2("ids", 256), "decoded_sha256": F.sha2("decoded", 256)}
    return done.withColumns(digests).select("doc_id", "lang", "source", "position", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mix_sources", mixed),
    ("byte_bpe", encoded),
]

#: Language ID, SimHash components and BPE cannot be put in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; the stages between are written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(out := fresh_dir(spark, name))
        docs = spark.read.parquet(out)
    return STAGES[-1][1](spark, docs, sf_dir)
