import pytest
from pyspark.sql import functions as F

from lociframe.functions import sequence as sq
from lociframe.functions import transforms as tf


@pytest.fixture()
def one(spark):
    def value(column, **values):
        df = spark.range(1)
        for n, v in values.items():
            df = df.withColumn(n, F.lit(v))
        return df.select(column.alias("x")).first()["x"]

    return value


S = None


@pytest.fixture(autouse=True)
def column(spark):
    global S
    S = F.col("s")



def test_reverse_complement(one):
    assert one(sq.reverse_complement(S), s="GATTACA") == "TGTAATC"
    assert one(sq.reverse_complement(S), s="TAGATAC") == "GTATCTA"
    assert one(sq.reverse_complement(sq.reverse_complement(S)), s="GATtaNca") == "GATtaNca"


def test_edits(one):
    assert one(sq.inserted(S, 3, F.lit("AG")), s="GATTACA") == "GATAGTA"
    assert one(sq.deleted(S, 3, 2), s="GATTACA") == "GATCANN"
    assert one(sq.deleted(S, 5, 9), s="GATTACA") == "GATTANN"
    assert one(sq.replaced(S, 0, F.lit("T")), s="GATTACA") == "TATTACA"
    assert [one(sq.shifted(S, k), s="GATTACA") for k in (0, 1, -1)] == ["GATTACA", "NGATTAC", "ATTACAN"]


def test_one_hot(one):
    hot = one(sq.one_hot(S), s="aCN")
    assert hot == [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 0, 0]]
    assert one(sq.one_hot(S, uniform=True), s="N") == [[0.25] * 4]
    assert one(sq.from_one_hot(sq.one_hot(S)), s="ACNGT") == "ACNGT"
    assert list(one(sq.indexed(S), s="acgtn")) == [0, 1, 2, 3, 4]
    assert one(sq.one_hot(S), s="") == []


def test_fitted_and_window(one):
    assert one(sq.fitted(S, 3), s="GATTACA") == "TTA"
    assert one(sq.fitted(S, 9), s="GATTACA") == "NGATTACAN"
    assert one(sq.window(S, F.lit(-2), F.lit(3)), s="GATTACA") == "NNGAT"
    assert one(sq.window(S, F.lit(5), F.lit(9)), s="GATTACA") == "CANN"
    assert one(sq.window(S, F.lit(20), F.lit(22)), s="GATTACA") == "NN"


def test_alleles(one):
    assert one(sq.with_allele(S, F.lit(3), F.lit("T"), F.lit("G")), s="GATTACA") == "GATGACA"
    assert one(sq.with_allele(S, F.lit(3), F.lit("TA"), F.lit("T")), s="GATTACA") == "GATTCAN"
    with pytest.raises(Exception, match="reference allele"):
        one(sq.with_allele(S, F.lit(3), F.lit("C"), F.lit("G")), s="GATTACA")


def test_saturation(spark):
    df = spark.createDataFrame([("x", "GAN")], "id string, s string")
    rows = {(r["pos"], r["nt"]): r["s"] for r in sq.saturation(df, "s", ["id"]).collect()}
    assert len(rows) == 3 + 3 + 4 and rows[0, "T"] == "TAN" and rows[2, "A"] == "GAA"


def test_small_functions(one):
    assert one(sq.cigar_length(S), s="10M2I5D3S4=") == 19
    assert one(sq.capped(S), s="ACGTACG") == "ACGTA*" and one(sq.capped(S), s="ACG") == "ACG"
    assert one(sq.without_version(S), s="ENSG01.12") == "ENSG01"
    assert one(sq.leading_parenthesis(S), s="(GATA4)_(x)") == "GATA4"
    assert one(sq.sized_rna(S, 3), s="GATTACA") == "ACA" and one(sq.sized_rna(S, 4), s="GA") == "GANN"
    assert one(sq.codon_start(F.array(*map(F.lit, [0, 1, 0, 0, 1, 0, 0])), F.lit(3))) == 1
    assert one(tf.truncated(F.lit(1.29), 1)) == 1.2
    assert one(tf.softplus(F.lit(800.0))) == 800.0
    assert one(tf.centre(F.array(*map(F.lit, range(7))), 3)) == [2, 3, 4]
    assert one(tf.every(F.array(*map(F.lit, range(5))), 2)) == [0, 2, 4]
    assert one(tf.length_mean(F.array(F.lit(2.0), F.lit(4.0), F.lit(9.0)), F.array(F.lit(True), F.lit(True), F.lit(False)))) == 3.0


def test_kmers_windows_and_alignment(spark):
    rows = {r["kmer"]: r["n"] for r in sq.all_kmers(spark, 3).collect()}
    assert len(rows) == 64 and "ACG" in rows and set(rows.values()) == {1.0}
    df = spark.createDataFrame([("f", "GATTACA", k, float(k)) for k in range(7)], "f string, s string, pos int, v double")
    assert {r["kmer"] for r in sq.activating_windows(df, "s", "pos", "v", 3, ["f"], share=0.9).collect()} == {"CAN"}
    assert {r["kmer"] for r in sq.activating_windows(df, "s", "pos", "v", 3, ["f"], above=4.5).collect()} == {"ACA", "CAN"}
    seqs = spark.createDataFrame([(k, "NGATTACN") for k in range(8)] + [(9, "GATTACNN")], "id int, s string")
    assert {r["id"]: r["shift"] for r in sq.aligned(seqs, "id", "s").collect()}[9] == 1
    cells = spark.createDataFrame([(1, "AG", [2.0, 3.0])], "id int, s string, v array<double>")
    assert {(r["pos"], r["nt"]): r["value"] for r in sq.scored_letters(cells, "s", "v").collect() if r["value"]} == {(0, "A"): 2.0, (1, "G"): 3.0}


def test_exact_sum(spark):
    """Sums do not depend on the order: 5.3 + 0.1 + 0.1 is 5.499999999999999 one way."""
    df = spark.createDataFrame([(5.3,), (0.1,), (0.1,), (None,)], "v double")
    total = lambda *more: df.unionByName(spark.createDataFrame([(x,) for x in more], "v double")).agg(tf.exact_sum(F.col("v")).alias("x")).first()["x"]
    assert total(0.0) == 5.5 and total(1e300) == 1e300 and total(1e-30) == 5.5 and total(-5.5, 1e-30) == 1e-30
    assert total(float("inf")) == float("inf") and str(total(float("nan"))) == "nan"
    assert df.where("v IS NULL").agg(tf.exact_sum(F.col("v")).alias("x")).first()["x"] is None


def test_array_slices_of_a_tied_sum(spark, tmp_path):
    """Hours' sums of exactly 5.5, their rows in any order, are rounded as such."""
    from lociframe.plans import catalogue

    rows = [(h * 3 + k, 1, "view", v, f"2024-01-01 {9 + h:02}:00:00") for h in range(3) for k, v in enumerate(5.3 if k == h else 0.1 for k in range(3))]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double, ts string")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartition(1).sortWithinPartitions("event_id").write.parquet(f"{tmp_path}/events.parquet")
    assert catalogue.QUERIES["array_slices"](spark, str(tmp_path)).first()["centre"] == "6,6,6,0,0,0"


def test_array_slices_of_odd_events(spark, tmp_path):
    """Without a user or a time, or from before the first day: as the SQL has it."""
    import duckdb

    from lociframe.plans import catalogue

    at = ["2024-01-01 10:00:00", None, "2023-12-31 23:30:00", "2023-12-31 10:00:00", "2023-12-30 23:10:00", "2024-01-03 12:00:00"]
    rows = [(k * 10 + i, user, "view", 1.5 + i, t) for k, user in enumerate([1, None, 2]) for i, t in enumerate(at)] + [(100, 3, "view", 2.0, None)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double, ts string")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    names = ["key", "centre", "centre_mean", "every", "length_mean"]
    got = [tuple(r) for r in catalogue.QUERIES["array_slices"](spark, str(tmp_path)).select(names).collect()]
    assert len(got) == 4 and set(got) == set(con.execute(catalogue.ORACLES["array_slices"]).fetchall())
