"""Genes, exons, polyadenylation sites and transcripts against windows and bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.operators.intervals import bins_touched, chain, overlap_join


def gene_bins(windows: DataFrame, segments: DataFrame, stride: int, id: str = "snp_id", gene: str = "gene_id", majority: bool = True, intron: bool = False, width: int = 1 << 14) -> DataFrame:
    """(id, gene, bin) of windows (id, chrom, start, end) and exons or spans (gene, chrom, start, end), each once. A bin
    counts by rounding (majority) or if it is touched at all; intron: one more at both sides of each segment."""
    a = windows.select(id, "chrom", F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = segments.select(gene, "chrom", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    met = overlap_join(a, b, "chrom", width=width)
    size = F.col("a_end") - F.col("a_start")
    first, last = F.greatest(F.col("b_start") - F.col("a_start"), F.lit(0)), F.least(F.col("b_end") - F.col("a_start"), size)
    bins = bins_touched(first, last, stride, majority)
    if intron:
        bins = F.when(F.size(bins) > 0, F.sequence(F.greatest(F.element_at(bins, 1) - 1, F.lit(0)), F.least(F.element_at(bins, -1) + 1, F.floor(size / stride) - 1)))
    return met.select(id, gene, F.explode(bins).alias("bin")).distinct()


def gene_signal(bins: DataFrame, signal: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Signal (keys of the window, bin, target_id, value) summed and averaged over each gene's bins."""
    met = bins.join(signal, [*keys, "bin"])
    return met.groupBy(*keys, "gene_id", "target_id").agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.count("*").alias("bins"))


def site_bins(windows: DataFrame, sites: DataFrame, stride: int, extend: int = 50, whole: float = 0.8, id: str = "snp_id", gene: str = "gene_id", mode: str = "before", take: int = 4) -> DataFrame:
    """(id, gene, site_num, bin) of genes of whose sites (gene, chrom, strand, site_num, start, end) at least the share
    lies whole in the window. mode: the bins of the site extended at both sides (at), or so many bins before it in
    transcription (before)."""
    both = windows.select(id, "chrom", F.col("start").alias("ws"), F.col("end").alias("we"))
    reach = sites.groupBy(gene).agg(F.first("chrom").alias("chrom"), F.min("start").alias("b_start"), F.max("end").alias("b_end"))
    near = overlap_join(both.withColumnsRenamed({"ws": "a_start", "we": "a_end"}), reach, "chrom", width=1 << 14).select(id, gene, F.col("a_start").alias("ws"), F.col("a_end").alias("we"))
    met = near.join(sites.drop("chrom"), gene).withColumn("__in", (F.col("start") >= F.col("ws")) & (F.col("end") <= F.col("we")))
    kept = met.groupBy(id, gene).agg(F.avg(F.col("__in").cast("double")).alias("__share")).where(F.col("__share") >= whole).drop("__share")
    inside = met.where("__in").join(kept, [id, gene])
    size = F.floor((F.col("we") - F.col("ws")) / stride)
    if mode == "at":
        first, last = F.floor((F.col("start") - extend - F.col("ws")) / stride), F.ceil((F.col("end") + extend - F.col("ws")) / stride) - 1
    elif mode == "before":
        here = F.floor((F.when(F.col("strand") == "-", F.col("end")).otherwise(F.col("start")) - F.col("ws")) / stride)
        first, last = F.when(F.col("strand") == "-", here + 1).otherwise(here - take), F.when(F.col("strand") == "-", here + take).otherwise(here - 1)
    else:
        raise ValueError(f"unknown mode {mode}")
    first, last = F.greatest(first, F.lit(0)).cast("bigint"), F.least(last, size - 1).cast("bigint")
    return inside.select(id, gene, "site_num", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))).alias("bin")).distinct()


def interval_sums(genes: DataFrame, track: DataFrame, gene: str = "gene_id", width: int = 1 << 12) -> DataFrame:
    """(gene, total, mean): a valued track over each gene's segments, by shared positions."""
    a = genes.select(gene, "chrom", F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = track.select("chrom", F.col("start").alias("b_start"), F.col("end").alias("b_end"), "value")
    met = overlap_join(a, b, "chrom", width=width)
    return met.groupBy(gene).agg(F.sum(F.col("value") * F.col("overlap")).alias("total"), (F.sum(F.col("value") * F.col("overlap")) / F.sum("overlap")).alias("mean"))


def split_of_points(points: DataFrame, segments: DataFrame, clusters: str | None = None, chrom: str = "chrom", pos: str = "pos", width: int = 1 << 16) -> DataFrame:
    """points with split, from the labelled segment (chrom, start, end, split) that holds each; a point in none takes the
    commonest split of its cluster (ties: the first by name), else null. The points have an id."""
    a = points.withColumn("__bin", F.floor(F.col(pos) / width))
    b = segments.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)))).select(F.col("chrom").alias(chrom), "__bin", F.col("start").alias("__s"), F.col("end").alias("__e"), F.col("split").alias("__split"))
    met = a.join(b, [chrom, "__bin"]).where((F.col(pos) >= F.col("__s")) & (F.col(pos) < F.col("__e"))).groupBy("id").agg(F.min("__split").alias("split"))
    found = points.join(met, "id", "left")
    if clusters is None:
        return found
    votes = found.where("split is not null").groupBy(clusters, "split").agg(F.count("*").alias("n"))
    best = votes.groupBy(clusters).agg(F.min_by("split", F.struct(-F.col("n"), "split")).alias("__fallback"))
    return found.join(best, clusters, "left").withColumn("split", F.coalesce("split", "__fallback")).drop("__fallback")


def transcript_position(variants: DataFrame, exons: DataFrame, transcript: str = "transcript_id") -> DataFrame:
    """variants (chrom, pos from 0) with the transcript and their position along its spliced exons (from 0, in the
    direction of its strand). exons: transcript, chrom, strand, start, end."""
    w = Window.partitionBy(transcript).orderBy("start")
    laid = exons.withColumn("__before", F.sum(F.col("end") - F.col("start")).over(w) - (F.col("end") - F.col("start")))
    whole = exons.groupBy(transcript).agg(F.sum(F.col("end") - F.col("start")).alias("__length"))
    a = variants.select("*", (F.col("pos") + 1).alias("__pe"))
    b = laid.join(whole, transcript).select(transcript, "chrom", "strand", "__before", "__length", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    met = overlap_join(a, b, "chrom", ("pos", "__pe"), ("b_start", "b_end"), 1 << 12)
    at = F.col("__before") + F.col("pos") - F.col("b_start")
    return met.withColumn("offset", F.when(F.col("strand") == "-", F.col("__length") - 1 - at).otherwise(at)).drop("__pe", "__before", "__length", "b_start", "b_end", "overlap")


def spliced(exons: DataFrame, transcript: str = "transcript_id") -> DataFrame:
    """(transcript, seq, junctions): exon sequences (with seq) joined in the direction of the strand, and the positions of
    the last base of each exon but the last."""
    from lociframe.functions.sequence import reverse_complement

    parts = exons.withColumn("__s", F.when(F.col("strand") == "-", reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
    order = F.when(F.col("strand") == "-", -F.col("start")).otherwise(F.col("start"))
    made = parts.groupBy(transcript).agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.col("__s").alias("s")))).alias("a"))
    ends = F.aggregate("a", F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("e")), lambda acc, x: F.struct((acc["n"] + F.length(x["s"])).alias("n"), F.array_append(acc["e"], acc["n"] + F.length(x["s"]) - 1).alias("e")), lambda acc: acc["e"])
    return made.select(transcript, F.array_join(F.transform("a", lambda x: x["s"]), "").alias("seq"), F.slice(ends, 1, F.size("a") - 1).alias("junctions"))


def coding_frame(length: Column, start: Column, end: Column) -> Column:
    """An array that is 1 at the first base of each codon of [start, end), else 0."""
    return F.transform(F.sequence(F.lit(0), length - 1), lambda i: ((i >= start) & (i < end) & ((i - start) % 3 == 0)).cast("int"))


def coding_saturation(df: DataFrame, seq: str, start: str, end: str, keys: list[str], stop: bool = True) -> DataFrame:
    """Single substitutions of transcripts with the coding end after each: where a substitution makes a codon of the frame
    a stop, and stop is set, the frame ends there."""
    from lociframe.functions.sequence import saturation

    held = [F.col(start).alias("__cs"), F.col(end).alias("__ce")]
    wide = saturation(df.select(*keys, seq, *held), seq, [*keys, "__cs", "__ce"])
    codon = F.col("__cs") + F.floor((F.col("pos") - F.col("__cs")) / 3) * 3
    inside = (F.col("pos") >= F.col("__cs")) & (F.col("pos") < F.col("__ce"))
    early = inside & F.upper(F.substring(F.col(seq), (codon + 1).cast("int"), F.lit(3))).isin("TAA", "TAG", "TGA") & (codon + 3 < F.col("__ce"))
    ended = F.when(early, codon).otherwise(F.col("__ce")) if stop else F.col("__ce")
    return wide.withColumns({"coding_start": F.col("__cs"), "coding_end": ended}).drop("__cs", "__ce")


def description_class(description: Column) -> Column:
    """CHIP:x:... is CHIP/x; else what stands before the first colon; * without one."""
    parts = F.split(description, ":")
    return F.when(F.instr(description, ":") == 0, "*").when(parts[0] == "CHIP", F.concat_ws("/", parts[0], parts[1])).otherwise(parts[0])


def sufficient(genes: DataFrame, lengths: DataFrame, window: int, share: float) -> DataFrame:
    """Genes (chrom, mid) whose window has less than the share of its positions beyond the chromosome."""
    start = F.col("mid") - window // 2
    beyond = F.greatest(-start, F.lit(0)) + F.greatest(start + window - F.col("length"), F.lit(0))
    return genes.join(lengths, "chrom").where((beyond == 0) | (beyond / window < share)).drop("length")


def mappable(flags: DataFrame, keys: list[str], most: float, bins: int) -> DataFrame:
    """Windows of so many bins whose share of flagged ones (keys, bin, flag) is below most."""
    return flags.groupBy(*keys).agg((F.count_if("flag") / bins).alias("share")).where(F.col("share") < most)


def clear_middle(flags: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Windows whose two middle bins are not flagged."""
    middle = F.col("bin").isin(bins // 2 - 1, bins // 2)
    return flags.groupBy(*keys).agg(F.count_if(F.col("flag") & middle).alias("hit")).where("hit = 0").drop("hit")


def active_blocks(coverage: DataFrame, gap: int = 50_000, key: str = "chrom", pos: str = "pos", value: str = "coverage", spread: bool = False) -> DataFrame:
    """(chrom, start, end) of stretches with coverage that no run of at least so many empty positions splits."""
    marked = chain(coverage.where(F.col(value) > 0), gap + 1, key, pos, spread)
    return marked.groupBy(key, "cluster").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end")).drop("cluster")


def final_coverage(unique: DataFrame, multi: DataFrame, clip: float, paired: bool, least: float = 0.003, chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    """Coverage of unique and multi-mapping reads: added, clipped, halved for pairs, tiny values zero."""
    both = unique.select(chrom, pos, F.col("n").cast("double").alias("v")).unionByName(multi.select(chrom, pos, F.col("weight").alias("v")))
    summed = both.groupBy(chrom, pos).agg(F.least(F.sum("v"), F.lit(clip)).alias("v"))
    value = F.col("v") / (2 if paired else 1)
    return summed.select(chrom, pos, F.when(value < least, 0.0).otherwise(value).alias("coverage"))
