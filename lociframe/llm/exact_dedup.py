"""Exact dedup by progressive refinement, with DataFrame functions only.

Texts are equal when they are identical without blanks ([\\x20\\x09-\\x0D]); null counts as empty. Rows are grouped by
length, those that share one by a hash of their first characters, and only rows of groups that survive both have their
full content hashed. The surviving groups reach the second scan as a bitmap of bounded size, so the texts themselves are
never shuffled; a chance hit in the bitmap costs one more hash and changes no result.

Defined results: of equal texts stays the row with the most code points in the original text, then the smallest id
(null ids last), then, of fully equal rows, exactly one. An empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.llm.common import BLANKS, cut, own_prefix
from lociframe.llm.repeats import bitmap, mark

#: Characters whose hash refines a length group.
PREFIX = 64

def normal(text: str) -> Column:
    """The text without blanks."""
    return reduce(lambda c, x: F.replace(c, F.lit(x)), BLANKS, F.coalesce(F.col(f"`{text}`"), F.lit("")))


def candidates(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str, str]:
    """docs with the normalised text and whether the row's length and prefix hash occur more than once, and the names of
    these two columns."""
    p = own_prefix(docs)
    made = docs.withColumn(whole := f"{p}normal", normal(text))
    key = [F.octet_length(whole), F.xxhash64(F.substring(whole, 1, PREFIX))]
    # counted by both at once, so that many copies are few rows before anything is joined by length
    seen = cut(made.groupBy(key[0].alias("length"), key[1].alias("prefix")).agg(F.count("*").alias("n")))
    lengths = seen.groupBy("length").agg(F.sum("n").alias("rows")).where("rows > 1").select("length")
    groups = seen.join(lengths, "length", "left_semi").where("n > 1").select("length", "prefix")
    return mark(made, key, bitmap(groups, seen.where("n > 1").count()), hit := f"{p}hit"), whole, hit


def exact_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", digest: str | None = None) -> DataFrame:
    """One row for each row of docs: id, keep_id (id of the row that stays), group_size, kept. digest names a column for
    the SHA-256 of every normalised text; without it only the texts of surviving groups are hashed."""
    seen, whole, hit = candidates(docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")), "text")
    full = F.sha2(whole, 256)
    rows = cut(
        seen.select(
            "id", F.monotonically_increasing_id().alias("uid"), F.coalesce(F.char_length("text"), F.lit(0)).alias("size"),
            F.col(hit).alias("hit"), (full if digest else F.when(F.col(hit), full)).alias("full"),
        )
    )
    order = F.struct((-F.col("size")).alias("size"), F.col("id").isNull().alias("none"), "id", "uid")
    groups = cut(rows.where("hit").groupBy("full").agg(F.min(order).alias("best"), F.count("*").alias("group_size")))
    groups = groups.select("full", F.col("best.id").alias("keep_id"), F.col("best.uid").alias("best"), "group_size")
    extra = [F.col("full").alias(digest)] if digest else []
    one = [F.col("id").alias(id)]
    alone = rows.where("not hit").select(*one, F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), *extra)
    shared = rows.where("hit").join(groups, "full").select(*one, "keep_id", "group_size", (F.col("uid") == F.col("best")).alias("kept"), *extra)
    return alone.unionByName(shared)


def drop_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that exact_groups does not keep; rows outside surviving groups are not shuffled, and each
    task passes on one row of a group at most."""
    seen, whole, hit = candidates(docs, text)
    full, rank = f"{hit}_full", f"{hit}_rank"
    order = [F.char_length(F.col(f"`{text}`")).desc_nulls_last(), F.col(f"`{id}`").asc_nulls_last(), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])]
    within = Window.partitionBy(full).orderBy(*order)
    shared = seen.where(F.col(hit)).withColumn(full, F.sha2(whole, 256)).drop(whole)
    shared = shared.withColumn(rank, F.row_number().over(within)).where(F.col(rank) == 1)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return seen.where(~F.col(hit)).select(*columns).unionByName(shared.select(*columns))
