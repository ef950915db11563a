import gzip

import pytest
from pyspark.sql import functions as F

from lociframe.plans import inference
from lociframe.sources import genomic as gn
from lociframe.streaming import metrics as st


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_bytes(gzip.compress(text.encode()) if name.endswith(".gz") else text.encode())
    return str(p)


def test_lengths_and_fasta(spark, tmp_path):
    assert {tuple(r) for r in gn.chromosome_lengths(spark, put(tmp_path, "x.genome", "chr1\t100\nchr2\t7\n")).collect()} == {("chr1", 100), ("chr2", 7)}
    fa = put(tmp_path, "x.fa", ">chr1 first\nGATT\nACA\n>chr2\nCC\n")
    assert {tuple(r) for r in gn.fasta(spark, fa).collect()} == {("chr1", "GATTACA"), ("chr2", "CC")}
    assert {tuple(r) for r in gn.chromosome_lengths(spark, fa).collect()} == {("chr1", 7), ("chr2", 2)}


def test_window_sequences(spark, tmp_path):
    tiles = gn.tiled(gn.fasta(spark, put(tmp_path, "x.fa", ">chr1\nGATTACAGATTACA\n")), 4)
    windows = spark.createDataFrame([("chr1", -2, 5, "+"), ("chr1", 3, 11, "+"), ("chr1", 10, 17, "-"), ("chr9", 0, 3, "+")], "chrom string, start bigint, end bigint, strand string")
    got = {(r["chrom"], r["start"]): r["seq"] for r in gn.window_sequences(windows, tiles, 4, stranded=True).collect()}
    assert got == {("chr1", -2): "NNGATTA", ("chr1", 3): "TACAGATT", ("chr1", 10): "NNNTGTA", ("chr9", 0): "NNN"}


def test_bed(spark, tmp_path):
    path = put(tmp_path, "x.bed.gz", "#c\nchr1\t10.0\t20\nchr1\t30\t50\tn\t0\t-\n")
    assert [tuple(r) for r in gn.bed(spark, path).orderBy("start").select("start", "end", "strand").collect()] == [(10, 20, "+"), (30, 50, "-")]
    assert [tuple(r) for r in gn.centred_bed(spark, path, 8).orderBy("start").select("start", "end").collect()] == [(11, 19), (36, 44)]
    assert gn.buffered(gn.bed(spark, path)).agg(F.min("start")).first()[0] == 0


GTF = 'c\ts\texon\t11\t20\t.\t+\t.\tgene_id "g1"; transcript_id "t1"; gene_id "g2";\nc\ts\texon\t15\t30\t.\t+\t.\tgene_id "g2"; transcript_id "t1";\nc\ts\tCDS\t16\t18\t.\t+\t.\tgene_id "g2"; transcript_id "t1";\nd\ts\texon\t1\t9\t.\t-\t.\tgene_id=g3;transcript_id=t2\n'


def test_gtf(spark, tmp_path):
    path = put(tmp_path, "x.gtf.gz", "#h\n" + GTF)
    genes = {r["gene_id"]: r for r in gn.genes(spark, path).collect()}
    assert set(genes) == {"g2", "g3"}
    assert [tuple(x) for x in genes["g2"]["exons"]] == [(10, 30)] and [tuple(x) for x in genes["g2"]["cds"]] == [(15, 18)]
    assert genes["g2"]["tss"] == 10 and genes["g3"]["tss"] == 8
    assert {tuple(r) for r in gn.transcript_genes(spark, path).collect()} == {("t1", "g2"), ("t2", "g3")}
    assert gn.genes(spark, path).where("gene_id = 'g2'").select(gn.exon_midpoint(F.col("exons")).alias("m")).first()["m"] == 19


VCF = "##x\n#CHROM\tPOS\tID\tREF\tALT\nchr1\t4\trs1\tT\tG\n1\t6\t.\tCA\tC,T\n"


def test_vcf_and_alleles(spark, tmp_path):
    v = gn.vcf(spark, put(tmp_path, "x.vcf", VCF))
    assert [tuple(r)[:4] for r in gn.sorted_variants(v).collect()] == [("rs1", "chr1", 4, "T"), ("chr1:6", "chr1", 6, "CA")]
    tiles = gn.tiled(gn.fasta(spark, put(tmp_path, "x.fa", ">chr1\nGATTACA\n")), 64)
    windows = gn.window_sequences(gn.variant_windows(v, 6).drop("alts").withColumn("alts", F.col("snp_id")).drop("alts"), tiles, 64)
    seqs = windows.join(v.select("snp_id", "alts"), "snp_id")
    got = {(r["snp_id"], r["allele"]): r["seq"] for r in gn.allele_sequences(seqs, 6).collect()}
    assert got["rs1", 0] == "ATTACA" and got["rs1", 1] == "ATGACA"
    assert got["chr1:6", 0] == "TACANN" and got["chr1:6", 1] == "TACNNN" and got["chr1:6", 2] == "TATNNN"
    f = {r["snp_id"]: r for r in gn.flipped(v).collect()}
    assert f["rs1"]["ref"] == "G" and f["rs1"]["flipped"] and not f["chr1:6"]["flipped"]


def test_a_wrong_reference_is_an_error(spark):
    df = spark.createDataFrame([("rs1", "C", ["A"], "GATTACA", 3)], "snp_id string, ref string, alts array<string>, seq string, offset int")
    with pytest.raises(Exception, match="neither allele"):
        gn.allele_sequences(df, 7).collect()


def test_targets_statistics_and_stores(spark, tmp_path):
    t = gn.targets(spark, put(tmp_path, "t.txt", "\tidentifier\tfile\tclip\tdescription\n0\ta\tf\t2\tCAGE:x\n")).first()
    assert t["target_id"] == 0 and t["clip"] == 2.0 and t["scale"] is None
    df = spark.createDataFrame([(0, "train", 0), (1, "train", 1), (2, "test", 0)], "seq_id bigint, label string, shard int")
    assert gn.statistics(df, pool_width=128).first().asDict() == {"pool_width": 128, "test_seqs": 1, "train_seqs": 2}
    gn.write_examples(df, str(tmp_path / "ex"))
    assert spark.read.parquet(str(tmp_path / "ex")).count() == 3
    with pytest.raises(ValueError, match="no reader"):
        gn.coverage(spark, "x.bw")


def test_net_motifs_and_ld(spark, tmp_path):
    net = put(tmp_path, "n.net", "net chr1 100\n fill 5 20 chrX + 7 22 id 1\n  gap 1 2 x\n fill 50 3 chrX + 9 3\nnet chr2 9\n fill 1 30 chrY - 2 30\n")
    assert [tuple(r) for r in gn.aligned_pairs(spark, net, 10).orderBy("chrom").collect()] == [("chr1", 5, 25, "chrX", 7, 29), ("chr2", 1, 31, "chrY", 2, 32)]
    proteins = gn.motif_proteins(spark, put(tmp_path, "m.meme", "MEME\nMOTIF M1 (GATA4)_x\nMOTIF M2 (FOX)\n"))
    hits = spark.createDataFrame([("f", "M2", 0.1), ("f", "M1", 0.1), ("g", "M9", 0.2)], "filter string, motif string, q double")
    assert {(r["filter"], r["motif"], r["protein"]) for r in gn.best_motifs(hits, proteins).collect()} == {("f", "M1", "GATA4"), ("g", "M9", None)}
    v = spark.createDataFrame([("a", "c", 1), ("b", "c", 5), ("z", "c", 9_000_000)], "snp_id string, chrom string, pos bigint")
    r = spark.createDataFrame([("a", "b", 0.5), ("a", "z", 0.9)], "snp_id string, partner string, r double")
    assert {tuple(x) for x in gn.ld_partners(v, r).collect()} == {("a", "b", 0.5), ("a", "a", 1.0), ("b", "b", 1.0), ("z", "z", 1.0)}


def test_inference_is_undone(spark):
    def load():
        return lambda seqs: [[[float(s.count(n)) for n in "AT"], [float(len(s)), 0.0]] for s in seqs]

    df = spark.createDataFrame([("x", "AAT"), ("y", "TTT")], "id string, seq string")
    plain = {(r["id"], r["bin"], r["target_id"]): r["value"] for r in inference.predict(df, load, ["id"]).collect()}
    assert plain["x", 0, 0] == 2 and plain["y", 0, 1] == 3
    both = inference.predict(inference.augmented(df), load, ["id", "shift", "reversed"])
    pairs = spark.createDataFrame([(0, 1), (1, 0)], "target_id int, strand_pair int")
    done = {(r["id"], r["bin"], r["target_id"]): r["value"] for r in inference.ensembled(inference.restored(both, 2, pairs), ["id"]).collect()}
    assert set(done) == set(plain)


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value", F.col("user_id").cast("double").alias("p"))
    rows.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = st.windowed_accuracy(stream, "ts", ["event_type"], "value", "p").writeStream.format("memory").queryName("acc").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r["event_type"], r["start"], r["n"], round(r["pearsonr"], 6)) for r in df.collect())
    assert key(spark.table("acc")) == key(st.windowed_accuracy(rows, "ts", ["event_type"], "value", "p"))


def test_sinks_of_sequences(spark, tmp_path):
    df = spark.createDataFrame([("a", "ACGT"), ("b", "GG")], "name string, seq string")
    gn.write_fasta(df.coalesce(1), str(tmp_path / "fa"))
    assert {tuple(r) for r in gn.fasta(spark, str(tmp_path / "fa")).collect()} == {("a", "ACGT"), ("b", "GG")}
    w = spark.createDataFrame([("m1", p, n, 0.25) for p in range(2) for n in "ACGT"], "motif string, pos int, nt string, freq double")
    b = spark.createDataFrame([(n, 0.25) for n in "ACGT"], "nt string, freq double")
    rows = gn.meme_motifs(w, b).collect()
    assert rows[0]["value"].startswith("MEME") and "MOTIF m1" in rows[1]["value"] and rows[1]["value"].count("0.25000 0.25000") == 4


def test_offsets_are_undone(spark):
    from lociframe.operators import intervals as iv

    laid = iv.offsets(spark.createDataFrame([("a", 10), ("b", 5)], "key string, length bigint"))
    got = iv.from_offset(spark.createDataFrame([(0,), (9,), (10,), (14,), (15,)], "place bigint"), laid).collect()
    assert sorted((r["place"], r["key"], r["pos"]) for r in got) == [(0, "a", 0), (9, "a", 9), (10, "b", 0), (14, "b", 4)]


def test_net_file_of_many_blocks(spark, tmp_path):
    """Fill lines at the head of a block take the net line of an earlier block, of their own file only."""
    rows = {f: [(f"chr{f}{c}", k, k + 10, "x", k + 1, k + 21) for c in range(3) for k in range(c, 90, 3)] for f in "ab"}
    for f, own in rows.items():
        text = "".join(f"net chr{f}{c} 1000\n" + "".join(f"  fill {s} 10 x + {o} 20 id 1\n" for chrom, s, _, _, o, _ in own if chrom == f"chr{f}{c}") for c in range(3))
        put(tmp_path, f"{f}.net", text)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = gn.aligned_pairs(spark, str(tmp_path), 10).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, got)) == sorted(rows["a"] + rows["b"])


def test_read_nets_writes_lines(spark, monkeypatch):
    """No row holds a file: a row as long as one comes to the driver with a sample of the rows."""
    from pyspark.sql.classic.dataframe import DataFrameWriter

    from lociframe.plans import catalogue

    longest, text = [], DataFrameWriter.text
    monkeypatch.setattr(DataFrameWriter, "text", lambda self, path: (longest.append(self._df.agg(F.max(F.length("value"))).first()[0]), text(self, path))[1])
    assert catalogue.QUERIES["read_nets"](spark, "/root/testdata/sf0.001").count() > 0
    assert max(longest) < 100


def test_second_places_of_like_variants(spark, tmp_path):
    """Lines alike but for the second place, or alike throughout, stay lines of their own, flipped or not."""
    path = put(tmp_path, "x.vcf", "##x\nchr1\t4\t.\tT\tG\t7\n1\t4\t.\tT\tG\t9\n1\t4\t.\tT\tG\t9\n1\t6\trs2\tCA\tC,T\t8\nchr2\t1\trs3\tA\tC\n")
    places = [("chr1:4", 4, 7), ("chr1:4", 4, 9), ("chr1:4", 4, 9), ("rs2", 6, 8), ("rs3", 1, None)]
    assert sorted((r["snp_id"], r["pos"], r["pos2"]) for r in gn.vcf(spark, path, second=True).collect()) == places
    turned = gn.vcf(spark, path, flip=True, second=True)
    assert turned.columns == ["snp_id", "chrom", "pos", "ref", "alts", "flipped", "pos2"]
    assert sorted((r["snp_id"], r["pos"], r["pos2"]) for r in turned.collect()) == places
    assert {(r["ref"], *r["alts"], r["flipped"]) for r in turned.where("pos = 4").collect()} == {("G", "T", True)}


def test_annotated_by_alleles(spark):
    """Of rows that share an id each score stays once, with the alleles that fit it."""
    scores = spark.createDataFrame([("a", "A", "C", 1.0), ("a", "A", "C", 1.0), ("a", "A", "G", 2.0), ("b", "T", "G", 3.0), ("c", "A", "C", 4.0)], "snp_id string, ref string, alt string, value double")
    reference = spark.createDataFrame([("a", "C", "A"), ("a", "C", "A"), ("a", "A", "G"), ("b", "T", "G"), ("b", None, "G")], "snp_id string, a1 string, a2 string")
    assert sorted(tuple(r) for r in gn.annotated(scores, reference).select("snp_id", "value").collect()) == [("a", -2.0), ("a", 1.0), ("a", 1.0), ("b", -3.0)]
    for other in ("('b', 'T', 'C')", "('b', 'T', NULL)"):
        with pytest.raises(Exception, match="alleles of b fit neither way"):
            gn.annotated(scores, spark.sql(f"SELECT * FROM VALUES {other} t(snp_id, a1, a2)")).collect()
