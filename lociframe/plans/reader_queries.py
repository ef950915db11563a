"""Readers on text that is made of the driver's tables, written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.checkpoint import fresh_dir
from lociframe.operators import alignments as al
from lociframe.operators import genes as gn
from lociframe.plans.catalogue import intervals, query, variants
from lociframe.session import table
from lociframe.sources import examples as ex
from lociframe.sources import genomic as io


def text_of(df: DataFrame, *fields: Column | str, suffix: str = "", head: str | None = None) -> str:
    """A new folder of text: one line for each row, its fields parted by tabs; head: a line of its own."""
    path = fresh_dir(df.sparkSession, "text") + suffix
    lines = df.select(F.concat_ws("\t", *[F.col(f).cast("string") if isinstance(f, str) else f.cast("string") for f in fields]).alias("value"))
    if head is not None:
        lines = df.sparkSession.range(1).select(F.lit(head).alias("value")).unionByName(lines)
    lines.write.text(path)
    return path


def _vcf(spark: SparkSession, sf_dir: str, *more: Column) -> str:
    rows = variants(spark, sf_dir)
    named = F.when(F.col("k") % 2 == 0, F.col("chrom")).otherwise(F.substring("chrom", 4, 9))
    return text_of(rows, named, "pos", "id", "ref", "alts", *more, head="##fileformat=VCFv4.2")


@query("SELECT snp_id, chrom, pos, ref, alts, false AS flipped FROM vr", "vr")
def read_vcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.vcf(spark, _vcf(spark, sf_dir)).withColumn("alts", F.array_join("alts", ","))


@query("SELECT snp_id, chrom, pos, CASE WHEN contains(alts, ',') THEN ref ELSE alts END AS ref, CASE WHEN contains(alts, ',') THEN alts ELSE ref END AS alts, NOT contains(alts, ',') AS flipped FROM vr", "vr")
def flip_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.vcf(spark, _vcf(spark, sf_dir), flip=True).withColumn("alts", F.array_join("alts", ","))


@query("SELECT snp_id, chrom, pos, k * 3 AS pos2 FROM vr", "vr")
def read_vcf_pos2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.vcf(spark, _vcf(spark, sf_dir, F.col("k") * 3), second=True).select("snp_id", "chrom", "pos", "pos2")


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM vr", "vr")
def vcf_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.vcf(spark, _vcf(spark, sf_dir)).agg(F.count("*").alias("n"))


_GTF = "SELECT key, s, e, okey, line, CASE WHEN line % 3 = 0 THEN 'CDS' ELSE 'exon' END AS feature, CASE WHEN okey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM iv"


def _gtf(spark: SparkSession, sf_dir: str) -> str:
    rows = intervals(spark, sf_dir)
    names = F.concat(F.lit('gene_id "g'), F.col("okey").cast("string"), F.lit('"; transcript_id "t'), F.col("okey").cast("string"), F.lit("."), (F.col("line") % 2).cast("string"), F.lit('";'))
    dot = F.lit(".")
    return text_of(rows, F.concat(F.lit("chr"), F.col("key").cast("string")), F.lit("x"), F.when(F.col("line") % 3 == 0, "CDS").otherwise("exon"), F.col("s") + 1, "e", dot, F.when(F.col("okey") % 2 == 0, "+").otherwise("-"), dot, names, head="#!genome")


@query(f"WITH g AS ({_GTF}) SELECT 'chr' || key AS chrom, feature, s AS start, e AS \"end\", strand, 'g' || okey AS gene, 't' || okey || '.' || line % 2 AS transcript FROM g", "iv")
def read_gtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = io.gtf(spark, _gtf(spark, sf_dir))
    return rows.select("chrom", "feature", "start", "end", "strand", F.col("attrs")["gene_id"].alias("gene"), F.col("attrs")["transcript_id"].alias("transcript"))


@query(f"WITH g AS ({_GTF}), x AS (SELECT * FROM g WHERE feature = 'exon'), m AS (SELECT *, max(e) OVER (PARTITION BY okey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x), i AS (SELECT *, sum(CASE WHEN s < reach THEN 0 ELSE 1 END) OVER (PARTITION BY okey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isle FROM m), j AS (SELECT okey, isle, min(s) AS s, max(e) AS e FROM i GROUP BY ALL), k AS (SELECT okey, count(*) AS n, sum(e - s) AS bases, sum((e - s) * (s + e - 1) / 2.0) AS weighed FROM j GROUP BY okey), w AS (SELECT okey, min('chr' || key) AS chrom, min(strand) AS strand, min(s) AS s, max(e) AS e FROM x GROUP BY okey), c AS (SELECT okey, count(*) AS n FROM g WHERE feature = 'CDS' GROUP BY okey) SELECT 'g' || w.okey AS gene_id, chrom, strand, s AS start, e AS \"end\", CASE WHEN strand = '-' THEN e - 1 ELSE s END AS tss, CAST(k.n AS INTEGER) AS exons, CAST(bases AS BIGINT) AS bases, CAST(floor(weighed / bases) AS BIGINT) AS middle, CAST(coalesce(c.n, 0) AS INTEGER) AS cds FROM w JOIN k ON k.okey = w.okey LEFT JOIN c ON c.okey = w.okey", "iv")
def gene_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = io.genes(spark, _gtf(spark, sf_dir))
    bases = F.aggregate("exons", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    return rows.select("gene_id", "chrom", "strand", "start", "end", "tss", F.size("exons").alias("exons"), bases.alias("bases"), io.exon_midpoint(F.col("exons")).alias("middle"), F.when(F.col("cds").isNull(), 0).otherwise(F.size("cds")).alias("cds"))


@query("SELECT DISTINCT 't' || okey || '.' || line % 2 AS transcript_id, 'g' || okey AS gene_id FROM iv", "iv")
def transcript_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.transcript_genes(spark, _gtf(spark, sf_dir))


def _fasta(spark: SparkSession, sf_dir: str) -> str:
    seq = F.translate(F.regexp_replace(F.lower("p_name"), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTNN")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.repeat(seq, F.col("p_size")).alias("s"))
    path = fresh_dir(spark, "text")
    rows.select(F.concat(F.lit(">c"), F.col("p_partkey").cast("string"), F.lit(" a part\n"), F.regexp_replace("s", "(.{1,13})", "$1\n")).alias("value")).write.text(path)
    return path


_FASTA = "SELECT p_partkey AS k, repeat(translate(regexp_replace(lower(p_name), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTNN'), p_size) AS s FROM part"


@query(f"WITH f AS ({_FASTA}) SELECT 'c' || k AS chrom, md5(s) AS seq, CAST(length(s) AS BIGINT) AS length FROM f")
def read_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _fasta(spark, sf_dir)
    return io.fasta(spark, path).withColumn("seq", F.md5("seq")).join(io.chromosome_lengths(spark, path), "chrom")


@query(f"WITH f AS ({_FASTA}), w AS (SELECT 'c' || k AS chrom, s, CAST(d - 20 AS BIGINT) AS start, CAST(d + 15 AS BIGINT) AS \"end\", d FROM f, (VALUES (0), (30), (61)) x(d)), q AS (SELECT *, substr(repeat('N', 100) || s || repeat('N', 200), 100 + start + 1, 35) AS q FROM w) SELECT chrom, start, \"end\", CASE WHEN d = 30 THEN '-' ELSE '+' END AS strand, CASE WHEN d = 30 THEN reverse(translate(q, 'ACGT', 'TGCA')) ELSE q END AS seq FROM q")
def tiled_window_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = io.fasta(spark, _fasta(spark, sf_dir))
    d = F.explode(F.array(F.lit(0), F.lit(30), F.lit(61))).alias("d")
    windows = whole.select("chrom", d).select("chrom", (F.col("d") - 20).cast("bigint").alias("start"), (F.col("d") + 15).cast("bigint").alias("end"), F.when(F.col("d") == 30, "-").otherwise("+").alias("strand"))
    return io.window_sequences(windows, io.tiled(whole, 16), 16, stranded=True)


@query("SELECT 'chr' || key AS chrom, greatest(s - 1220, 0) AS start, e - 1180 AS \"end\", 'n' || okey AS name FROM iv", "iv")
def read_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals(spark, sf_dir)
    path = text_of(rows, F.concat(F.lit("chr"), F.col("key").cast("string")), F.format_string("%.1f", (F.col("s") - 1200).cast("double")), F.col("e") - 1200, F.concat(F.lit("n"), F.col("okey").cast("string")))
    return io.buffered(io.bed(spark, path)).select("chrom", "start", "end", "name")


@query("WITH w AS (SELECT DISTINCT key, s // 512 * 512 AS ws FROM iv WHERE line = 1), p AS (SELECT key, ws, ws + unnest(range(0, 64)) AS pos FROM w), t AS (SELECT key, s, e, CAST(line AS DOUBLE) AS v FROM iv WHERE e > s) SELECT p.key, p.ws, p.pos, round(coalesce(sum(v), 0), 6) AS value FROM p LEFT JOIN t ON t.key = p.key AND t.s <= p.pos AND p.pos < t.e GROUP BY ALL", "iv")
def range_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bedGraph track read for windows, position by position."""
    rows = intervals(spark, sf_dir)
    track = io.coverage(spark, text_of(rows.where("e > s"), "key", "s", "e", F.col("line").cast("double"), suffix=".bedgraph", head="track type=bedGraph"))
    windows = rows.where("line = 1").select(F.col("key").cast("string").alias("chrom"), (F.floor(F.col("s") / 512) * 512).alias("start")).distinct()
    windows = windows.select(F.struct("chrom", "start").alias("seq_id"), "chrom", "start", (F.col("start") + 64).alias("end"))
    done = io.range_signal(windows, track, 64)
    return done.select(F.col("seq_id.chrom").cast("bigint").alias("key"), F.col("seq_id.start").alias("ws"), "pos", F.round("value", 6).alias("value"))


@query("SELECT DISTINCT 'chr' || key AS chrom, s AS start, e AS \"end\", 1.0::DOUBLE AS value FROM iv", "iv")
def peak_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.coverage(spark, text_of(intervals(spark, sf_dir), F.concat(F.lit("chr"), F.col("key").cast("string")), "s", "e", suffix=".narrowPeak"))


@query("SELECT 'chr' || c_nationkey AS chrom, o_orderkey AS start, o_orderkey + 5 + o_custkey % 7 AS \"end\", 'other' || o_custkey AS other_chrom, o_custkey AS other_start, o_custkey + 6 + o_orderkey % 5 AS other_end FROM orders JOIN customer ON c_custkey = o_custkey WHERE 5 + o_custkey % 7 >= 7 AND 6 + o_orderkey % 5 >= 7")
def read_nets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A net file for each nation: a net line, and fill lines of its customers' orders, some of them nested."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    word = lambda c: c.cast("string")
    line = F.concat_ws(" ", F.when(F.col("o_orderkey") % 2 == 0, " fill").otherwise("   fill"), word(F.col("o_orderkey")), word(5 + F.col("o_custkey") % 7), F.concat(F.lit("other"), word(F.col("o_custkey"))), F.lit("+"), word(F.col("o_custkey")), word(6 + F.col("o_orderkey") % 5), F.lit("id 1"))
    ends = rows.select("c_nationkey").distinct().select("c_nationkey", F.explode(F.array(F.struct(F.lit(0).alias("place"), F.concat(F.lit("net chr"), word(F.col("c_nationkey")), F.lit(" 1000")).alias("value")), F.struct(F.lit(2).alias("place"), F.lit(" gap 1 2").alias("value")))).alias("x")).select("c_nationkey", "x.*")
    lines = rows.select("c_nationkey", F.lit(1).alias("place"), line.alias("value")).unionByName(ends)
    path = fresh_dir(spark, "text")
    lines.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "place", "value").select("c_nationkey", "value").write.partitionBy("c_nationkey").text(path)
    return io.aligned_pairs(spark, path, 7)


@query("SELECT s_suppkey AS target_id, s_name AS identifier, 'f' || s_suppkey AS file, 'CHIP:' || s_name AS description, CAST(NULL AS INTEGER) AS genome, s_nationkey + 0.5 AS clip, CAST(NULL AS DOUBLE) AS clip_soft, CAST(NULL AS DOUBLE) AS scale, CASE WHEN s_suppkey % 2 = 0 THEN 'sum' ELSE 'mean' END AS sum_stat, CAST(NULL AS INTEGER) AS strand_pair FROM (SELECT CAST(s_suppkey AS INTEGER) AS s_suppkey, s_name, s_nationkey::DOUBLE AS s_nationkey FROM supplier)")
def read_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of targets that lacks some of the optional columns."""
    s = table(spark, sf_dir, "supplier")
    path = fresh_dir(spark, "targets")
    key = F.col("s_suppkey").cast("string")
    s.select(F.col("s_suppkey").alias("index"), F.col("s_name").alias("identifier"), F.concat(F.lit("f"), key).alias("file"), (F.col("s_nationkey") + 0.5).alias("clip"), F.when(F.col("s_suppkey") % 2 == 0, "sum").otherwise("mean").alias("sum_stat"), F.concat(F.lit("CHIP:"), "s_name").alias("description")).write.option("header", True).option("sep", "\t").csv(path)
    return io.targets(spark, path)


@query("SELECT p_partkey % 40 AS f, min(struct_pack(q := CAST(p_size AS INTEGER), m := 'M' || p_partkey)).m AS motif, min(CAST(p_size AS INTEGER)) AS q, 'P' || substr(min(struct_pack(q := CAST(p_size AS INTEGER), m := 'M' || p_partkey)).m, 2) AS protein FROM part GROUP BY 1")
def best_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motif names of a MEME file, and the best hit of each filter among them."""
    p = table(spark, sf_dir, "part")
    name = F.concat(F.lit("M"), F.col("p_partkey").cast("string"))
    path = fresh_dir(spark, "text")
    p.select(F.concat(F.lit("MOTIF "), name, F.lit(" (P"), F.col("p_partkey").cast("string"), F.lit(")_(Homo)\nletter-probability matrix: w= 1\n 0.25 0.25 0.25 0.25")).alias("value")).write.text(path)
    hits = p.select((F.col("p_partkey") % 40).alias("filter"), name.alias("motif"), F.col("p_size").cast("int").alias("q"))
    return io.best_motifs(hits, io.motif_proteins(spark, path)).withColumnRenamed("filter", "f")


_SAM = "SELECT okey, line, key, s, CAST((okey * 37 + line) % 2048 AS INTEGER) AS flag, e - s AS n, okey % 4 AS nh FROM iv"


def _sam(spark: SparkSession, sf_dir: str) -> str:
    rows = intervals(spark, sf_dir)
    n, nh = F.col("e") - F.col("s"), F.col("okey") % 4
    cigar = F.concat(F.lit("2S"), n.cast("string"), F.lit("M1I3D2N"))
    tags = F.when(nh == 0, F.lit("AS:i:5")).when(nh == 3, "XA:Z:chr1,+5,9M,0;chr2,-8,9M,1;").otherwise(F.concat(F.lit("NH:i:"), nh.cast("string")))
    return text_of(rows, F.concat(F.lit("r"), F.col("okey").cast("string"), F.lit("."), F.col("line").cast("string")), (F.col("okey") * 37 + F.col("line")) % 2048, F.concat(F.lit("chr"), F.col("key").cast("string")), F.col("s") + 1, F.lit(60), cigar, F.lit("="), F.lit(9), F.col("line") * 10 - 30, F.lit("ACGT"), F.lit("IIII"), F.lit("RG:Z:NH"), tags, head="@HD\tVN:1.6")


@query(f"WITH x AS ({_SAM}) SELECT 'r' || okey || '.' || line AS read_id, flag & 1 = 0 OR flag & 64 <> 0 AS read1, flag & 1 <> 0 AS paired, flag & 2 <> 0 AS proper, flag & 4 = 0 AS mapped, flag & 1024 <> 0 AS duplicate, CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS strand, 'chr' || key AS chrom, s AS pos, s + n + 5 AS \"end\", line * 10 - 30 AS template, CAST(CASE nh WHEN 0 THEN 1 WHEN 3 THEN 3 ELSE nh END AS INTEGER) AS n_hits FROM x", "iv")
def read_sam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.sam(spark, _sam(spark, sf_dir)).drop("cigar", "xa")


@query(f"WITH x AS ({_SAM}), k AS (SELECT * FROM x WHERE flag & 4 = 0 AND flag & 1024 = 0), h AS (SELECT 'r' || okey || '.' || line AS r, 'chr' || key AS chrom, s AS pos FROM k UNION ALL SELECT 'r' || okey || '.' || line, a.c, a.p FROM k, (VALUES ('chr1', 4), ('chr2', 7)) a(c, p) WHERE nh = 3), w AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY r) AS weight FROM h) SELECT chrom, CAST(pos AS BIGINT) AS pos, round(sum(weight) + 0.01, 6) AS coverage FROM w GROUP BY ALL", "iv")
def sam_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped reads that are no duplicates, with their other hits, as coverage."""
    reads = al.mapped(io.sam(spark, _sam(spark, sf_dir)))
    own = reads.select("read_id", "chrom", "pos")
    other = reads.select("read_id", F.explode(al.alternative_hits(F.col("xa"))).alias("h")).select("read_id", "h.chrom", "h.pos")
    return al.coverage(al.weighted_hits(own.unionByName(other))).withColumn("coverage", F.round("coverage", 6))


@query(f"WITH x AS ({_SAM}) SELECT bool_or(flag & 1 <> 0) AS paired, CAST(round(avg(abs(line * 10 - 30)) FILTER (WHERE flag & 2 <> 0) / 2) AS BIGINT) AS shift FROM x", "iv")
def read_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = io.sam(spark, _sam(spark, sf_dir))
    return ex.is_paired(reads).crossJoin(reads.where("proper").agg(al.pair_shift(F.col("template")).alias("shift")))


@query("WITH n AS (SELECT key, id, v, pos // 1800 AS b FROM pt), u AS (SELECT key, b, count(*) AS n FROM n WHERE id % 3 <> 0 GROUP BY ALL), m AS (SELECT key, b, sum(0.001 + id % 3 * 0.0) AS w FROM n WHERE id % 3 = 0 GROUP BY ALL), s AS (SELECT key, b, sum(v) AS v FROM (SELECT key, b, n::DOUBLE AS v FROM u UNION ALL SELECT key, b, w FROM m) GROUP BY ALL) SELECT key, b, round(CASE WHEN least(v, 2.0) / 2 < 0.003 THEN 0.0 ELSE least(v, 2.0) / 2 END, 6) AS coverage FROM s", "pt")
def final_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociframe.plans.catalogue import points

    rows = points(spark, sf_dir).withColumn("b", F.floor(F.col("pos") / 1800))
    unique = rows.where("id % 3 <> 0").groupBy("key", "b").agg(F.count("*").alias("n"))
    multi = rows.where("id % 3 = 0").groupBy("key", "b").agg((F.count("*") * 0.001).alias("weight"))
    return gn.final_coverage(unique, multi, 2.0, True, chrom="key", pos="b").withColumn("coverage", F.round("coverage", 6))


@query("SELECT CAST(8 AS INTEGER) AS pool, CAST(count(*) FILTER (WHERE l_returnflag = 'A') AS BIGINT) AS \"A_seqs\", CAST(count(*) FILTER (WHERE l_returnflag = 'N') AS BIGINT) AS \"N_seqs\", CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS \"R_seqs\" FROM lineitem")
def split_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.statistics(table(spark, sf_dir, "lineitem"), "l_returnflag", pool=8)


@query("SELECT c_nationkey % 5 AS t, 'chr' || (c_nationkey % 5 + 1) AS chrom, CAST(count(*) AS BIGINT) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY ALL")
def by_chromosome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store with a folder for each chromosome, the chromosome read from the path."""
    path = fresh_dir(spark, "store")
    rows = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 5).alias("t"), F.col("c_acctbal").alias("v"), F.concat(F.lit("chr"), (F.col("c_nationkey") % 5 + 1).cast("string")).alias("c"))
    rows.write.partitionBy("c").parquet(path)
    return io.by_chromosome(spark, path).groupBy("t", "chrom").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"))


@query("WITH b AS (SELECT key, pos // 3600 % 24 AS bin, sum(v) AS v FROM pt GROUP BY ALL) SELECT 'u' || key AS chrom, CAST(key * 100000 + 500 + bin * 128 AS BIGINT) AS start, CAST(key * 100000 + 628 + bin * 128 AS BIGINT) AS \"end\", round(v, 6) AS value FROM b", "pt")
def write_bedgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of windows written as bedGraph and read back."""
    from lociframe.plans.catalogue import points

    rows = points(spark, sf_dir)
    bins = rows.groupBy(F.col("key").alias("seq_id"), (F.floor(F.col("pos") / 3600) % 24).alias("bin")).agg(F.round(F.sum("v"), 6).alias("value"))
    windows = rows.select(F.col("key").alias("seq_id"), F.concat(F.lit("u"), F.col("key").cast("string")).alias("chrom"), (F.col("key") * 100000).alias("start")).distinct()
    path = fresh_dir(spark, "track") + ".bedgraph"
    io.write_bedgraph(io.bins_to_bedgraph(bins, windows, 128, 500), path)
    return io.coverage(spark, path)
