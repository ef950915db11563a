"""Readers of the usual exchange formats as typed tables, and their writers. Text is read by Spark (plain or gzip), never
by the driver; rows keep their meaning by columns, not by the order of lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BED = T.StructType([T.StructField("chrom", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("name", T.StringType()), T.StructField("score", T.StringType()), T.StructField("strand", T.StringType())])

#: Blocks of files, about, that a broadcast may have.
FEW = 100_000


def _fields(spark: SparkSession, path: str | list[str]) -> DataFrame:
    lines = spark.read.text(path).where((F.length(F.trim("value")) > 0) & ~F.col("value").startswith("#"))
    return lines.select(F.split("value", "\t").alias("f"))


def _get(k: int) -> Column:
    return F.get("f", F.lit(k))


def _chrom() -> Column:
    return F.when(_get(0).startswith("chr"), _get(0)).otherwise(F.concat(F.lit("chr"), _get(0)))


def chromosome_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, length) of a two-column table, or of a FASTA file."""
    first = spark.read.text(path).where(F.length(F.trim("value")) > 0).limit(1).collect()
    if first and first[0]["value"].startswith(">"):
        return fasta(spark, path).select("chrom", F.length("seq").cast("bigint").alias("length"))
    return _fields(spark, path).select(_get(0).alias("chrom"), _get(1).cast("bigint").alias("length"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, seq): one row for each record; a record is one text of at most 2 GB, split at its >."""
    records = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    head, body = F.substring_index("value", "\n", 1), F.expr("substring(value, instr(value, '\n') + 1)")
    return records.select(F.regexp_extract(head, r"^\s*(\S+)", 1).alias("chrom"), F.regexp_replace(F.when(F.instr("value", "\n") > 0, body).otherwise(""), r"\s+", "").alias("seq"))


def tiled(sequences: DataFrame, tile: int = 1 << 16) -> DataFrame:
    """(chrom, tile, seq): sequences cut into fixed tiles, for joins with windows."""
    at = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.floor((F.length("seq") - 1) / tile), F.lit(0)).cast("bigint"))).alias("tile")
    return sequences.select("chrom", at, "seq").select("chrom", "tile", F.substring("seq", (F.col("tile") * tile + 1).cast("int"), F.lit(tile)).alias("seq"))


def window_sequences(windows: DataFrame, tiles: DataFrame, tile: int = 1 << 16, stranded: bool = False) -> DataFrame:
    """windows (chrom, start, end) with seq: positions beyond the chromosome are N; where stranded, rows whose strand is
    - have the reverse complement."""
    from lociframe.functions.sequence import reverse_complement

    numbered = windows.withColumn("__id", F.struct(*windows.columns))
    touched = numbered.withColumn("tile", F.explode(F.sequence(F.greatest(F.floor(F.col("start") / tile), F.lit(0)), F.greatest(F.floor((F.col("end") - 1) / tile), F.lit(0)))))
    met = touched.join(tiles, ["chrom", "tile"], "left")
    base = F.col("tile") * tile
    first, last = F.greatest(F.col("start") - base, F.lit(0)), F.least(F.col("end") - base, F.length("seq"))
    part = F.when(F.col("seq").isNotNull() & (last > first), F.substring("seq", (first + 1).cast("int"), (last - first).cast("int"))).otherwise("")
    joined = met.groupBy("__id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tile", part.alias("s")))), lambda x: x["s"]), "").alias("s"))
    left = F.greatest(-F.col("__id.start"), F.lit(0))
    size = F.col("__id.end") - F.col("__id.start")
    seq = F.rpad(F.concat(F.repeat(F.lit("N"), F.least(left, size).cast("int")), "s"), size.cast("int"), F.lit("N"))
    out = joined.select("__id.*", seq.alias("seq"))
    return out.withColumn("seq", F.when(F.col("strand") == "-", reverse_complement(F.col("seq"))).otherwise(F.col("seq"))) if stranded else out


def bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, name, score, strand (+ where it has none); starts may be written as decimals."""
    return _fields(spark, path).select(_get(0).alias("chrom"), _get(1).cast("double").cast("bigint").alias("start"), _get(2).cast("double").cast("bigint").alias("end"), _get(3).alias("name"), _get(4).alias("score"), F.coalesce(_get(5), F.lit("+")).alias("strand"))


def centred_bed(spark: SparkSession, path: str, length: int) -> DataFrame:
    from lociframe.operators.intervals import recentre

    first, last = recentre(F.col("start"), F.col("end"), length)
    return bed(spark, path).withColumns({"start": first, "end": last})


def buffered(blacklist: DataFrame, buffer: int = 20) -> DataFrame:
    return blacklist.withColumns({"start": F.greatest(F.col("start") - buffer, F.lit(0).cast("bigint")), "end": F.col("end") + buffer})


def bedgraph(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^(#|track|browser|\s*$)")).select(F.split("value", r"\s+").alias("f"))
    return rows.select(_get(0).alias("chrom"), _get(1).cast("bigint").alias("start"), _get(2).cast("bigint").alias("end"), _get(3).cast("double").alias("value"))


def coverage(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, value) by the file's suffix: bedGraph, peaks (BED: ones), or Parquet of that schema."""
    kind = path.removesuffix(".gz").rsplit(".", 1)[-1].lower()
    if kind in ("bedgraph", "bg", "bedg"):
        return bedgraph(spark, path)
    if kind in ("bed", "narrowpeak", "broadpeak"):
        return bed(spark, path).select("chrom", "start", "end", F.lit(1.0).alias("value")).distinct()
    if kind == "parquet":
        return spark.read.parquet(path).select("chrom", "start", "end", "value")
    raise ValueError(f"no reader for .{kind}: store the track as bedGraph or Parquet")


def range_signal(windows: DataFrame, track: DataFrame, width: int = 4096) -> DataFrame:
    """(seq_id, pos, value) for every position of windows (seq_id, chrom, start, end); 0 where the track has none."""
    from lociframe.operators.intervals import overlap_join

    left = windows.select("seq_id", "chrom", F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    right = track.select("chrom", F.col("start").alias("b_start"), F.col("end").alias("b_end"), "value")
    met = overlap_join(left, right, "chrom", width=width)
    held = met.select("seq_id", F.explode(F.sequence(F.greatest("a_start", "b_start"), F.least("a_end", "b_end") - 1)).alias("pos"), "value")
    every = windows.select("seq_id", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))
    summed = held.groupBy("seq_id", "pos").agg(F.sum("value").alias("value"))
    return every.join(summed, ["seq_id", "pos"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def attributes(text: Column) -> Column:
    """`key "value";` or `key=value;` text as a map; the last of equal keys counts."""
    pairs = F.transform(F.filter(F.split(text, r";\s*"), lambda x: F.length(F.trim(x)) > 0), lambda x: F.struct(F.regexp_extract(F.trim(x), r'^([^\s="]+)', 1).alias("key"), F.regexp_replace(F.regexp_replace(F.trim(x), r'^[^\s="]+[\s=]*', ""), '^"|"$', "").alias("value")))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["key"]), F.create_map(p["key"], p["value"])))


def gtf(spark: SparkSession, path: str, feature: str | list[str] | None = None) -> DataFrame:
    """chrom, source, feature, start and end (0-based, half-open), strand, attrs."""
    rows = _fields(spark, path).where(F.size("f") >= 9)
    made = rows.select(_get(0).alias("chrom"), _get(1).alias("source"), _get(2).alias("feature"), (_get(3).cast("bigint") - 1).alias("start"), _get(4).cast("bigint").alias("end"), _get(6).alias("strand"), attributes(_get(8)).alias("attrs"))
    return made if feature is None else made.where(F.col("feature").isin([feature] if isinstance(feature, str) else feature))


def genes(spark: SparkSession, path: str, key: str = "gene_id") -> DataFrame:
    """(gene_id, chrom, strand, exons, cds, start, end, tss) from exon and CDS rows, keyed by an attribute; overlapping
    exons are merged, touching ones are not."""
    from lociframe.operators.intervals import merge

    rows = gtf(spark, path, ["exon", "CDS"]).withColumn(key, F.col("attrs")[key]).where(F.col(key).isNotNull())
    whole = rows.where("feature = 'exon'").groupBy(key).agg(F.min("chrom").alias("chrom"), F.min("strand").alias("strand"), F.min("start").alias("start"), F.max("end").alias("end"))
    exons = merge(rows.where("feature = 'exon'"), key, touching=False).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("exons"))
    cds = rows.where("feature = 'CDS'").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cds"))
    tss = F.when(F.col("strand") == "-", F.col("end") - 1).otherwise(F.col("start"))
    return whole.join(exons, key).join(cds, key, "left").withColumn("tss", tss)


def exon_midpoint(exons: Column) -> Column:
    """The whole-number mean of all exonic positions."""
    total = F.aggregate(exons, F.lit(0.0), lambda a, x: a + (x["end"] - x["start"]) * (x["start"] + x["end"] - 1) / 2)
    size = F.aggregate(exons, F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    return F.floor(total / size)


def transcript_genes(spark: SparkSession, path: str) -> DataFrame:
    """(transcript_id, gene_id), no line left out."""
    return gtf(spark, path).select(F.col("attrs")["transcript_id"].alias("transcript_id"), F.col("attrs")["gene_id"].alias("gene_id")).where("transcript_id is not null and gene_id is not null").distinct()


def vcf(spark: SparkSession, path: str, flip: bool = False, second: bool = False) -> DataFrame:
    """snp_id, chrom (with chr), pos (from 1), ref, alts, flipped. A missing id becomes chrom:pos. flip: single
    alternatives change places with the reference. second: also pos2, the sixth field, a place in another genome."""
    rows = _fields(spark, path)
    more = [_get(5).cast("bigint").alias("pos2")] if second else []
    made = rows.select(_chrom().alias("chrom"), _get(1).cast("bigint").alias("pos"), _get(2).alias("id"), _get(3).alias("ref"), F.split(_get(4), ",").alias("alts"), *more)
    made = made.select(F.when(F.col("id") == ".", F.concat_ws(":", "chrom", F.col("pos").cast("string"))).otherwise(F.col("id")).alias("snp_id"), "chrom", "pos", "ref", "alts", F.lit(False).alias("flipped"), *["pos2"] * second)
    return flipped(made) if flip else made


def flipped(variants: DataFrame) -> DataFrame:
    one = F.size("alts") == 1
    rest = [c for c in variants.columns if c not in ("snp_id", "chrom", "pos", "ref", "alts", "flipped")]
    return variants.select("snp_id", "chrom", "pos", F.when(one, F.col("alts")[0]).otherwise(F.col("ref")).alias("ref"), F.when(one, F.array("ref")).otherwise(F.col("alts")).alias("alts"), F.when(one, ~F.col("flipped")).otherwise(F.col("flipped")).alias("flipped"), *rest)


def sorted_variants(variants: DataFrame) -> DataFrame:
    return variants.orderBy("chrom", "pos", "snp_id")


def variant_windows(variants: DataFrame, length: int) -> DataFrame:
    """start (from 0), end and offset: a window with the variant at length // 2 - 1, longer on the right where the
    reference is longer than every alternative, so that a deletion stays whole."""
    extra = F.greatest(F.length("ref") - F.array_max(F.transform("alts", F.length)), F.lit(0))
    return variants.withColumns({"start": F.col("pos") - length // 2, "end": F.col("pos") - length // 2 + length + extra, "offset": F.lit(length // 2 - 1)})


def allele_sequences(windows: DataFrame, length: int) -> DataFrame:
    """From windows with seq: one row for the reference and one for each alternative: snp_id, allele, seq. A sequence
    that carries a single alternative in place of the reference counts as flipped; one that carries neither is an
    error."""
    seq, at = F.upper("seq"), F.col("offset")
    held = lambda a: F.substring(seq, at + 1, F.length(a)) == F.upper(a)
    turned = ~held(F.col("ref")) & (F.size("alts") == 1) & held(F.col("alts")[0])
    base = F.when(held(F.col("ref")), F.col("ref")).when(turned, F.col("alts")[0]).otherwise(F.raise_error(F.concat(F.lit("neither allele of "), "snp_id", F.lit(" is in the sequence"))))
    alleles = F.array_insert("alts", 1, F.col("ref"))
    each = windows.withColumn("__base", base).select("*", F.posexplode(alleles).alias("allele", "__a"))
    made = F.concat(F.left(seq, at), F.upper("__a"), F.substring(seq, at + F.length("__base") + 1, F.length("seq")))
    return each.select("snp_id", "allele", F.rpad(F.left(made, F.lit(length)), F.lit(length), F.lit("N")).alias("seq"))


def two_genomes(variants: DataFrame, first: DataFrame, second: DataFrame, length: int) -> DataFrame:
    """(snp_id, allele, seq): of variants with pos and pos2 the reference in the one genome and the alternative in the
    other, each in the middle of a window of its own; an error where a genome does not carry its allele, or where there
    are several alternatives. first, second: tiles (chrom, tile, seq)."""
    single = variants.withColumn("__alt", F.when(F.size("alts") == 1, F.col("alts")[0]).otherwise(F.raise_error(F.concat(F.lit("several alternatives of "), "snp_id"))))
    left, out = length // 2 - 1, None
    for allele, (tiles, pos, held) in enumerate(((first, "pos", "ref"), (second, "pos2", "__alt"))):
        start = F.col(pos) - 1 - left
        windows = single.select("snp_id", "chrom", start.alias("start"), (start + length + F.length(held)).alias("end"), F.col(held).alias("held"))
        seq = F.upper("seq")
        fits = F.substring(seq, F.lit(left + 1), F.length("held")) == F.upper("held")
        bad = F.raise_error(F.concat(F.lit("a genome does not carry its allele of "), "snp_id")).cast("string")
        rows = window_sequences(windows, tiles).select("snp_id", F.lit(allele).alias("allele"), F.when(fits, F.left(seq, F.lit(length))).otherwise(bad).alias("seq"))
        out = rows if out is None else out.unionByName(rows)
    return out


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of SAM text: read_id, read1 (of pairs, or single), paired, proper, mapped, duplicate, strand, chrom, pos
    (from 0), end (by the CIGAR), cigar, template, n_hits (the NH tag, else one and those of XA), xa."""
    from lociframe.functions.sequence import cigar_length

    rows = spark.read.text(path).where((F.length(F.trim("value")) > 0) & ~F.col("value").startswith("@")).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 11)
    flag = _get(1).try_cast("int")
    bit = lambda n: flag.bitwiseAND(F.lit(n)) != 0
    tag = lambda name: F.substring(F.get(F.filter(F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0))), lambda x: x.startswith(name)), F.lit(0)), 6, 1 << 30)
    xa, pos, cigar = tag("XA:Z:"), _get(3).try_cast("bigint") - 1, F.nullif(_get(5), F.lit("*"))
    hits = F.coalesce(tag("NH:i:").try_cast("int"), 1 + F.coalesce(F.length(xa) - F.length(F.replace(xa, F.lit(";"))), F.lit(0)))
    return rows.select(
        _get(0).alias("read_id"), (~bit(1) | bit(64)).alias("read1"), bit(1).alias("paired"), bit(2).alias("proper"), (~bit(4)).alias("mapped"),
        bit(1024).alias("duplicate"), F.when(bit(16), "-").otherwise("+").alias("strand"), F.nullif(_get(2), F.lit("*")).alias("chrom"), pos.alias("pos"),
        (pos + cigar_length(cigar)).alias("end"), cigar.alias("cigar"), _get(8).try_cast("bigint").alias("template"), hits.alias("n_hits"), xa.alias("xa"),
    )


def ld_partners(variants: DataFrame, r: DataFrame, radius: int = 1_000_000, least: float = 0.1) -> DataFrame:
    """(snp_id, partner, r): partners above the threshold within the radius, and each itself at 1. r: snp_id, partner, r."""
    a = variants.select("snp_id", "chrom", F.col("pos").alias("__p"))
    b = variants.select(F.col("snp_id").alias("partner"), F.col("chrom").alias("__c"), F.col("pos").alias("__q"))
    met = r.join(a, "snp_id").join(b, "partner").where((F.col("chrom") == F.col("__c")) & (F.abs(F.col("__p") - F.col("__q")) <= radius) & (F.col("r") > least))
    own = variants.select("snp_id", F.col("snp_id").alias("partner"), F.lit(1.0).alias("r"))
    return met.where("snp_id != partner").select("snp_id", "partner", "r").unionByName(own)


def annotated(scores: DataFrame, reference: DataFrame) -> DataFrame:
    """scores (snp_id, ref, alt, value), each row once, where a table of snp_id, a1, a2 has their id: the sign is turned
    where ref is a1. Of several alleles of an id those that fit count, unturned ones first; none is an error."""
    alleles = reference.groupBy("snp_id").agg(F.collect_set(F.when(F.col("a1").isNotNull() & F.col("a2").isNotNull(), F.struct("a1", "a2"))).alias("__a"))
    held = lambda a1, a2: F.exists("__a", lambda x: (x["a1"] == F.col(a1)) & (x["a2"] == F.col(a2)))
    fits = F.when(held("alt", "ref"), F.col("value")).when(held("ref", "alt"), -F.col("value"))
    bad = F.raise_error(F.concat(F.lit("alleles of "), "snp_id", F.lit(" fit neither way"))).cast("double")
    known = F.coalesce(held("alt", "ref") | held("ref", "alt"), F.lit(False))
    return scores.join(alleles, "snp_id").withColumn("value", F.when(known, fits).otherwise(bad)).drop("__a")


def targets(spark: SparkSession, path: str) -> DataFrame:
    """The targets table: its first column is the index; optional columns that it lacks are null."""
    kinds = {"identifier": "string", "file": "string", "description": "string", "genome": "int", "clip": "double", "clip_soft": "double", "scale": "double", "sum_stat": "string", "strand_pair": "int"}
    raw = spark.read.option("header", True).option("sep", "\t").csv(path)
    return raw.select(F.col(f"`{raw.columns[0]}`").cast("int").alias("target_id"), *[(F.col(n) if n in raw.columns else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])


def aligned_pairs(spark: SparkSession, path: str, least: int = 0) -> DataFrame:
    """Fill lines of a net file, with the chromosome of the net line before them: chrom, start, end, other_chrom,
    other_start, other_end. Lines are read block by block, in their order; the fill lines at the head of a block take the
    last net line of the file's blocks before it, so files may be of any size."""
    from lociframe.checkpoint import cut

    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(path).select("value", *place)
    net = F.regexp_extract("value", r"^\s*net\s+(\S+)", 1)
    nets = F.when(net != "", F.struct(F.monotonically_increasing_id().alias("at"), net.alias("chrom")))
    marks = cut(lines.select("file", "block", nets.alias("net")).groupBy("file", "block").agg(F.max("net").alias("net")))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select("file", "block", F.last("net.chrom", True).over(before).alias("__before"))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = chrom = None
        for batch in batches:
            rows = []
            for line, *own in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own != at:
                    at, chrom = own, None
                f = line.split()
                if f[:1] == ["net"]:
                    chrom = f[1]
                elif f[:1] == ["fill"] and int(f[2]) >= least and int(f[6]) >= least:
                    rows.append((*own, chrom, int(f[1]), int(f[1]) + int(f[2]), f[3], int(f[5]), int(f[5]) + int(f[6])))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["file", "block", "chrom", "start", "end", "other_chrom", "other_start", "other_end"])

    fills = lines.mapInArrow(over, "file string, block bigint, chrom string, start bigint, end bigint, other_chrom string, other_start bigint, other_end bigint")
    few = marks.limit(FEW + 1).count() <= FEW
    met = fills.join(F.broadcast(carried) if few else carried, ["file", "block"], "left")
    return met.withColumn("chrom", F.coalesce("chrom", "__before")).drop("file", "block", "__before")


def motif_proteins(spark: SparkSession, path: str) -> DataFrame:
    """(motif, protein) of the MOTIF lines of a MEME file."""
    rows = spark.read.text(path).where(F.col("value").startswith("MOTIF")).select(F.split("value", r"\s+").alias("f"))
    return rows.select(_get(1).alias("motif"), F.regexp_replace(F.regexp_extract(F.coalesce(_get(2), F.lit("")), r"^\(?([^)]*)", 1), r"[()]", "").alias("protein"))


def best_motifs(hits: DataFrame, proteins: DataFrame) -> DataFrame:
    """hits (filter, motif, q): for each filter the motif of the lowest q, ties by motif, with its protein."""
    best = hits.groupBy("filter").agg(F.min_by("motif", F.struct("q", "motif")).alias("motif"), F.min("q").alias("q"))
    return best.join(proteins, "motif", "left")


def write_bed(df: DataFrame, path: str) -> None:
    df.select(*[c for c in ("chrom", "start", "end", "label", "name", "score", "strand") if c in df.columns]).write.mode("overwrite").option("sep", "\t").csv(path)


def bins_to_bedgraph(df: DataFrame, windows: DataFrame, pool: int, crop: int = 0) -> DataFrame:
    """(seq_id, bin, value) as (chrom, start, end, value) intervals of windows."""
    start = F.col("start") + crop + F.col("bin") * pool
    return df.join(windows.select("seq_id", "chrom", "start"), "seq_id").select("chrom", start.alias("start"), (start + pool).alias("end"), "value")


def write_bedgraph(df: DataFrame, path: str) -> None:
    df.select("chrom", "start", "end", "value").orderBy("chrom", "start").write.mode("overwrite").option("sep", "\t").csv(path)


def write_examples(df: DataFrame, path: str, label: str = "label", shard: str = "shard") -> None:
    """Examples as Parquet by label and shard, each shard one file."""
    df.repartition(label, shard).sortWithinPartitions("seq_id").write.mode("overwrite").partitionBy(label, shard).parquet(path)


def statistics(df: DataFrame, label: str = "label", **geometry: int) -> DataFrame:
    """One row: the geometry, and how many sequences each label has."""
    return df.groupBy().pivot(label).agg(F.count(F.lit(1))).select(*[F.lit(v).alias(k) for k, v in geometry.items()], *[F.col(f"`{c}`").alias(f"{c}_seqs") for c in [r[0] for r in df.select(label).distinct().orderBy(label).collect()]])


def write_statistics(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def by_chromosome(spark: SparkSession, path: str) -> DataFrame:
    """Per-chromosome Parquet stores as one table, the chromosome from the path."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(path)
    return rows if "chrom" in rows.columns else rows.withColumn("chrom", F.regexp_extract(F.input_file_name(), r"(chr[0-9A-Za-z]+)", 1))


def read_order(df: DataFrame, order: list[str]) -> DataFrame:
    """df with seq_id: numbers from 0 by the order, taken once and kept, so that no later step relies on rows' places."""
    return df.withColumn("seq_id", F.row_number().over(Window.orderBy(*order)).cast("bigint") - 1)


def write_fasta(df: DataFrame, path: str, name: str = "name", seq: str = "seq") -> None:
    df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(seq)).alias("value")).write.mode("overwrite").text(path)


def meme_motifs(weights: DataFrame, background: DataFrame, motif: str = "motif", sites: int = 20) -> DataFrame:
    """One row of text for the head of a MEME file (from nt, freq), and one for each motif (from motif, pos, nt, freq), with
    their order."""
    number = lambda c: F.format_string("%.5f", c)
    letters = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nt", "freq"))), lambda x: F.concat(x["nt"], F.lit(" "), number(x["freq"]))), " ")
    head = background.agg(F.concat(F.lit("MEME version 4\n\nALPHABET= ACGT\n\nBackground letter frequencies:\n"), letters, F.lit("\n")).alias("value")).select(F.lit("").alias(motif), "value")
    rows = weights.groupBy(motif, "pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("nt", "freq"))), lambda x: number(x["freq"])).alias("r"))
    body = rows.groupBy(motif).agg(F.sort_array(F.collect_list(F.struct("pos", F.array_join("r", " ").alias("l")))).alias("a"))
    text = F.concat(F.lit("MOTIF "), F.col(motif).cast("string"), F.lit("\nletter-probability matrix: alength= 4 w= "), F.size("a").cast("string"), F.lit(f" nsites= {sites}\n"), F.array_join(F.transform("a", lambda x: x["l"]), "\n"), F.lit("\n"))
    return head.unionByName(body.select(F.col(motif).cast("string").alias(motif), text.alias("value"))).orderBy(motif)
