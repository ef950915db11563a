import duckdb
import pytest
from pyspark.sql import functions as F

from lociframe.operators import analysis as an
from lociframe.operators import genes as gn
from lociframe.plans import catalogue
from lociframe.sources import examples as ex


def test_gene_bins(spark):
    w = spark.createDataFrame([("s", "c", 0, 512)], "snp_id string, chrom string, start bigint, end bigint")
    g = spark.createDataFrame([("g", "c", 60, 200), ("h", "c", 600, 700), ("i", "d", 0, 50)], "gene_id string, chrom string, start bigint, end bigint")
    assert sorted((r["gene_id"], r["bin"]) for r in gn.gene_bins(w, g, 128).collect()) == [("g", 0), ("g", 1)]
    assert sorted(r["bin"] for r in gn.gene_bins(w, g, 128, intron=True).collect()) == [0, 1, 2]


@pytest.mark.parametrize("strand,want", [("+", [0, 1, 2, 3]), ("-", [5, 6, 7, 8])])
def test_site_bins(spark, strand, want):
    w = spark.createDataFrame([("s", "c", 0, 320)], "snp_id string, chrom string, start bigint, end bigint")
    sites = spark.createDataFrame([("g", "c", strand, 1, 130, 131), ("h", "c", strand, 1, 5, 6), ("h", "c", strand, 2, 900, 901)], "gene_id string, chrom string, strand string, site_num int, start bigint, end bigint")
    assert sorted(r["bin"] for r in gn.site_bins(w, sites, 32).collect()) == want
    assert sorted(r["bin"] for r in gn.site_bins(w, sites, 32, extend=0, mode="at").collect()) == [4]
    with pytest.raises(ValueError, match="unknown mode"):
        gn.site_bins(w, sites, 32, mode="x")


EXONS = [("t", "c", "+", 10, 13, "GAT"), ("t", "c", "+", 20, 22, "TA"), ("u", "c", "-", 10, 13, "GAT"), ("u", "c", "-", 20, 22, "TA")]


def test_transcripts(spark):
    exons = spark.createDataFrame(EXONS, "transcript_id string, chrom string, strand string, start bigint, end bigint, seq string")
    got = {r["transcript_id"]: (r["seq"], r["junctions"]) for r in gn.spliced(exons).collect()}
    assert got == {"t": ("GATTA", [2]), "u": ("TAATC", [1])}
    v = spark.createDataFrame([("x", "c", 21), ("y", "c", 15)], "snp_id string, chrom string, pos bigint")
    assert {(r["snp_id"], r["transcript_id"], r["offset"]) for r in gn.transcript_position(v, exons).collect()} == {("x", "t", 4), ("x", "u", 0)}


def test_coding_saturation(spark):
    df = spark.createDataFrame([("t", "ATGTACAAATAA", 0, 12)], "id string, seq string, cs int, ce int")
    rows = {(r["pos"], r["nt"]): r["coding_end"] for r in gn.coding_saturation(df, "seq", "cs", "ce", ["id"]).collect()}
    assert len(rows) == 36 and rows[5, "A"] == 3 and rows[5, "T"] == 12 and rows[6, "T"] == 6
    frame = spark.range(1).select(gn.coding_frame(F.lit(7), F.lit(1), F.lit(6)).alias("f")).first()["f"]
    assert frame == [0, 1, 0, 0, 1, 0, 0]


def test_filters(spark):
    genes = spark.createDataFrame([("a", "c", 50), ("b", "c", 2), ("d", "c", 99)], "gene_id string, chrom string, mid bigint")
    lengths = spark.createDataFrame([("c", 100)], "chrom string, length bigint")
    assert {r["gene_id"] for r in gn.sufficient(genes, lengths, 20, 0.45).collect()} == {"a", "b"}
    flags = spark.createDataFrame([("w", k, k == 3) for k in range(8)] + [("x", k, k < 6) for k in range(8)], "w string, bin int, flag boolean")
    assert [r["w"] for r in gn.mappable(flags, ["w"], 0.5, 8).collect()] == ["w"] and gn.clear_middle(flags, ["w"], 8).count() == 0


def test_final_coverage(spark):
    a = spark.createDataFrame([("c", 1, 3), ("c", 2, 90)], "chrom string, pos bigint, n int")
    b = spark.createDataFrame([("c", 1, 0.5), ("c", 9, 0.004)], "chrom string, pos bigint, weight double")
    assert {r["pos"]: r["coverage"] for r in gn.final_coverage(a, b, 50.0, True).collect()} == {1: 1.75, 2: 25.0, 9: 0.0}


def test_equal_buckets(spark):
    for n, rows in ((4, 10), (3, 7), (5, 5), (4, 3)):
        df = spark.range(rows).select("id", F.col("id").alias("v"))
        got = {r["id"]: r["quantile"] for r in an.equal_buckets(df, "v", n, "id").collect()}
        assert got == {k: max(q for q in range(n) if q * rows // n <= k) for k in range(rows)}


def test_roc_points(spark):
    df = spark.createDataFrame([("t", True, 3.0), ("t", False, 2.0), ("t", True, 1.0), ("t", False, 0.0)], "t string, y boolean, s double")
    got = {r["k"]: r["tpr"] for r in an.roc_points(df, ["t"], "y", "s", 5).collect()}
    assert got == {0: 0.5, 1: 0.5, 2: 1.0, 3: 1.0, 4: 1.0}


def test_alternative_starts(spark):
    rows = [("g", "a", 0, k, 2.0**k, 2.0**k) for k in range(4)] + [("g", "b", 100, k, 9.0, 9.0) for k in range(4)] + [("g", "c", 900, k, 1.0 + k, 1.0) for k in range(4)]
    df = spark.createDataFrame(rows, "gene_id string, tss_id string, pos bigint, target_id int, y double, p double")
    r = an.alternative_starts(df, 500).first()
    assert (r["a"], r["b"], r["n"]) == ("a", "c", 4) and r["pearsonr"] > 0.9


def test_examples(spark, tmp_path):
    bins = spark.createDataFrame([(s, b, t, float(b * 10 + t)) for s in (0, 1) for b in range(4) for t in range(2) if (b, t) != (3, 1)], "seq_id bigint, bin int, target_id int, value double")
    made = ex.stacked(bins, 4, 2).withColumn("label", F.lit("train")).withColumn("seq", F.lit("ACGT"))
    made.write.parquet(str(tmp_path / "x"))
    assert ex.read(spark, str(tmp_path / "x"), "train").first()["targets"] == [[0, 1], [10, 11], [20, 21], [30, 0]]
    assert ex.read(spark, str(tmp_path / "x"), crop=1).first()["targets"] == [[10, 11], [20, 21]]
    assert ex.read(spark, str(tmp_path / "x"), step=2, targets=[1], seed=3).first()["targets"] == [[1], [21]]
    assert ex.summary(made).first().asDict() == {"sequences": 2, "length": 4, "bins": 4, "depth": 2, "nonzero": 2}
    ref = spark.createDataFrame([(0, "acgt"), (1, "ACGA")], "seq_id bigint, seq string")
    assert ex.checked(made.where("seq_id = 0"), ref).count() == 1
    with pytest.raises(Exception, match="differs from the reference"):
        ex.checked(made, ref).collect()


def test_score_store(spark):
    v = spark.createDataFrame([("a", "c", 1, "T", ["G"], True), ("b", "c", 2, "A", ["C", "G"], False)], "snp_id string, chrom string, pos bigint, ref string, alts array<string>, flipped boolean")
    s = spark.createDataFrame([("a", 0, "SAD", 1.0), ("b", 0, "SAD", 2.0)], "snp_id string, target_id int, stat string, value double")
    assert {(r["snp_id"], r["ref_allele"], r["alt_allele"]) for r in ex.score_store(v, s).collect()} == {("a", "G", "T"), ("b", "A", "C,G")}


def test_score_store_of_shared_ids(spark):
    """Variants that share an id: by a name of their own each score stays with its alleles; by the id equal ones count once."""
    v = spark.createDataFrame([(1, "c:1", "c", 1, "A", ["C"], False), (2, "c:1", "c", 1, "A", ["C"], False), (3, "c:1", "c", 1, "A", ["G"], True)], "k bigint, snp_id string, chrom string, pos bigint, ref string, alts array<string>, flipped boolean")
    s = spark.createDataFrame([(k, "c:1", 0, "SAD", float(k)) for k in (1, 2, 3)], "k bigint, snp_id string, target_id int, stat string, value double")
    rows = lambda df: sorted((r["snp_id"], r["value"], r["ref_allele"], r["alt_allele"]) for r in df.collect())
    assert rows(ex.score_store(v.where("k < 3").drop("k"), s.drop("k").where("value < 3"))) == [("c:1", 1.0, "A", "C"), ("c:1", 2.0, "A", "C")]
    assert rows(ex.score_store(v, s, "k")) == [("c:1", 1.0, "A", "C"), ("c:1", 2.0, "A", "C"), ("c:1", 3.0, "G", "A")]
    with pytest.raises(Exception, match="different variants are called c:1"):
        ex.score_store(v.drop("k"), s.drop("k")).collect()


def test_score_store_query_of_repeated_keys(spark, tmp_path):
    """Keys that stand for several rows, with another nation, with none or all alike: each row's scores, as in the SQL."""
    rows = [(4, 1), (4, 2), (4, None), (7, 3), (7, 3), (9, None), (11, 3), (5, 3), (None, 3)]
    spark.createDataFrame(rows, "c_custkey bigint, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = con.execute(f"SELECT snp_id, target_id, ref_allele, alt_allele, value FROM ({catalogue.ORACLES['score_store']})").fetchall()
    got = [tuple(r) for r in catalogue.QUERIES["score_store"](spark, str(tmp_path)).collect()]
    assert len(want) == 14
    assert sorted(got, key=repr) == sorted(want, key=repr)
