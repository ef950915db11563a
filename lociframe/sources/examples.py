"""Training examples and score stores as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociframe.operators.ordered import numbered

EXAMPLES = T.StructType([T.StructField("seq_id", T.LongType()), T.StructField("label", T.StringType()), T.StructField("seq", T.StringType()), T.StructField("targets", T.ArrayType(T.ArrayType(T.FloatType())))])

#: Transcripts: their sequence, coding frame and junctions, with one value for each target.
RNA = T.StructType([T.StructField("seq_id", T.LongType()), T.StructField("label", T.StringType()), T.StructField("seq", T.StringType()), T.StructField("coding", T.ArrayType(T.IntegerType())), T.StructField("splice", T.ArrayType(T.IntegerType())), T.StructField("targets", T.ArrayType(T.FloatType()))])


def stacked(bins: DataFrame, n_bins: int, n_targets: int) -> DataFrame:
    """(seq_id, targets): long bins (seq_id, bin, target_id, value) as arrays of bins by targets; cells that are missing
    are 0. Each cell knows its place, so their order on the way does not matter."""
    cells = F.map_from_entries(F.collect_list(F.struct((F.col("bin") * n_targets + F.col("target_id")).cast("bigint").alias("k"), F.col("value").cast("float").alias("v"))))
    made = bins.groupBy("seq_id").agg(cells.alias("m"))
    at = lambda b, t: F.coalesce(F.element_at("m", (b * n_targets + t).cast("bigint")), F.lit(0.0).cast("float"))
    return made.select("seq_id", F.transform(F.sequence(F.lit(0), F.lit(n_bins - 1)), lambda b: F.transform(F.sequence(F.lit(0), F.lit(n_targets - 1)), lambda t: at(b, t))).alias("targets"))


def read(spark: SparkSession, path: str, label: str | None = None, seed: int | None = None, crop: int = 0, step: int = 1, targets: list[int] | None = None) -> DataFrame:
    """Examples of one label, in a random order for training or else by seq_id; targets cropped at both ends, each
    step-th bin, and only the targets that are named."""
    df = spark.read.parquet(path)
    df = df if label is None else df.where(F.col("label") == label)
    if crop or step > 1:
        kept = F.slice("targets", crop + 1, F.size("targets") - 2 * crop)
        df = df.withColumn("targets", F.filter(kept, lambda x, i: i % step == 0))
    if targets is not None:
        df = df.withColumn("targets", F.transform("targets", lambda b: F.transform(F.array(*map(F.lit, targets)), lambda k: b[k])))
    return df.orderBy("seq_id") if seed is None else df.orderBy(F.rand(seed))


def summary(df: DataFrame) -> DataFrame:
    """(sequences, length, bins, depth, nonzero): counted over all examples; nonzero are targets with any signal."""
    flat = df.select(F.length("seq").alias("length"), F.size("targets").alias("bins"), F.size(F.col("targets")[0]).alias("depth"))
    sizes = flat.agg(F.count("*").alias("sequences"), F.max("length").alias("length"), F.max("bins").alias("bins"), F.max("depth").alias("depth"))
    each = df.select(F.explode("targets").alias("b")).select(F.posexplode("b").alias("t", "v")).groupBy("t").agg(F.bool_or(F.col("v") != 0).alias("any"))
    return sizes.crossJoin(F.broadcast(each.agg(F.count_if("any").alias("nonzero"))))


def long(df: DataFrame) -> DataFrame:
    """(seq_id, bin, target_id, value) of examples."""
    return df.select("seq_id", F.posexplode("targets").alias("bin", "b")).select("seq_id", "bin", F.posexplode("b").alias("target_id", "value"))


def checked(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Examples whose sequence equals the reference's (seq_id, seq) letter by letter; an error where one does not."""
    other = reference.select("seq_id", F.col("seq").alias("__r"))
    bad = F.raise_error(F.concat(F.lit("sequence "), F.col("seq_id").cast("string"), F.lit(" differs from the reference"))).cast("string")
    return df.join(other, "seq_id").withColumn("seq", F.when(F.upper("seq") == F.upper("__r"), F.col("seq")).otherwise(bad)).drop("__r")


def score_store(variants: DataFrame, scores: DataFrame, by: str = "snp_id") -> DataFrame:
    """Scores (snp_id, target_id, stat, value) with their variants, whose alleles are turned back where they were
    flipped. by: the column of both that names a variant; where places share a snp_id, one of its own (scores need no
    snp_id then). Equal variants of a name count once, different ones are an error."""
    back = F.col("flipped")
    alleles = (F.when(back, F.col("alts")[0]).otherwise(F.col("ref")).alias("ref_allele"), F.when(back, F.col("ref")).otherwise(F.array_join("alts", ",")).alias("alt_allele"))
    named = variants.select(F.col(by).alias("__by"), F.struct("snp_id", "chrom", "pos", *alleles).alias("v")).groupBy("__by").agg(F.min("v").alias("v"), F.max("v").alias("__w"))
    bad = F.raise_error(F.concat(F.lit("different variants are called "), F.col("__by").cast("string")))
    store = named.select("__by", F.when(F.col("v").eqNullSafe(F.col("__w")), F.col("v")).otherwise(bad).alias("v")).select(F.col("__by").alias(by), *[f"v.{c}" for c in ("snp_id", "chrom", "pos", "ref_allele", "alt_allele") if c != by])
    return store.join(scores if by == "snp_id" else scores.drop("snp_id"), by)


def write_scores(df: DataFrame, path: str) -> None:
    """One folder for each statistic and chromosome, so that a lookup reads what it needs."""
    df.write.mode("overwrite").partitionBy("stat", "chrom").parquet(path)


def lookup(scores: DataFrame, snps: DataFrame, snp: str = "snp_id", order: str = "snp_index") -> DataFrame:
    """The scores of the variants asked for, by their id; of several variants that share one, those of the last."""
    asked = scores.join(snps.select(snp).distinct(), snp, "left_semi")
    last = asked.groupBy(snp).agg(F.max(order).alias(order))
    return asked.join(last, [snp, order])


def negatives(df: DataFrame, most: int = 16384, seed: int = 44, id: str = "id") -> DataFrame:
    """df where it has at most so many rows; else so many draws of its rows, each any row's with the same chance, so a row
    may come more than once. draw numbers them; rows are numbered by their id over any number of tasks."""
    n = df.count()
    if n <= most:
        return df.withColumn("draw", F.lit(None).cast("bigint"))
    drawn = df.sparkSession.range(most).select(F.col("id").alias("draw"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).alias("__k"))
    return numbered(df, [], [id], "__k", True).join(drawn, "__k").drop("__k")


def is_paired(reads: DataFrame) -> DataFrame:
    """One row: whether any read is one of a pair."""
    return reads.agg(F.coalesce(F.bool_or("paired"), F.lit(False)).alias("paired"))
