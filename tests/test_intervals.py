import random

import pytest
from pyspark.sql import functions as F

from lociframe.operators import intervals as iv
from lociframe.operators import splits as sp


def frame(spark, rows, columns="key string, start bigint, end bigint"):
    return spark.createDataFrame(rows, columns)


def spans(df, *names):
    return sorted(tuple(r) for r in df.select(*(names or ("start", "end"))).collect())


def test_subtract(spark):
    whole = frame(spark, [("chr1", 0, 100), ("chr2", 5, 9)])
    gaps = frame(spark, [("chr1", 10, 20), ("chr1", 50, 60), ("chr3", 0, 5)])
    assert spans(iv.subtract(whole, gaps), "key", "start", "end") == [("chr1", 0, 10), ("chr1", 20, 50), ("chr1", 60, 100), ("chr2", 5, 9)]


def test_subtract_edges(spark):
    whole = frame(spark, [("a", 10, 20)])
    assert spans(iv.subtract(whole, frame(spark, [("a", 0, 12), ("a", 18, 30)]))) == [(12, 18)]
    assert spans(iv.subtract(whole, frame(spark, [("a", 0, 50)]))) == []
    assert spans(iv.subtract(whole, frame(spark, [("a", 30, 50)]))) == [(10, 20)]
    assert spans(iv.subtract(whole, frame(spark, []))) == [(10, 20)]


def test_tile(spark):
    df = frame(spark, [("a", 0, 10)])
    assert [s for s, _ in spans(iv.tile(df, 4, 3))] == [0, 3, 6]
    assert [s for s, _ in spans(iv.tile(df, 4, 3, inclusive=False))] == [0, 3]
    assert [s for s, _ in spans(iv.tile(frame(spark, [("a", 3, 12)]), 4, 3, snap=5))] == [5, 8]
    assert spans(iv.tile(frame(spark, [("a", 0, 3)]), 4, 3)) == []


def test_rejoin_and_merge(spark):
    df = frame(spark, [("a", 0, 5), ("a", 5, 9), ("a", 12, 15)])
    assert spans(iv.rejoin(df)) == [(0, 9), (12, 15)]
    assert spans(iv.merge(df)) == [(0, 9), (12, 15)]
    assert spans(iv.merge(df, touching=False)) == [(0, 5), (5, 9), (12, 15)]


def test_break_large_loses_nothing(spark):
    assert spans(iv.break_large(frame(spark, [("a", 0, 10), ("a", 20, 22)]), 3)) == [(0, 2), (2, 5), (5, 7), (7, 10), (20, 22)]


@pytest.mark.parametrize("width", [1, 7, 64])
def test_overlap_join_equals_brute_force(spark, width):
    rnd = random.Random(width)
    rows = [(rnd.choice("ab"), s := rnd.randrange(60), s + rnd.randrange(1, 20)) for _ in range(60)]
    a = frame(spark, rows, "key string, a_start bigint, a_end bigint")
    b = frame(spark, rows, "key string, b_start bigint, b_end bigint")
    want = sorted((k, s, e, t, f, min(e, f) - max(s, t)) for k, s, e in rows for m, t, f in rows if k == m and s < f and t < e)
    assert spans(iv.overlap_join(a, b, width=width), "key", "a_start", "a_end", "b_start", "b_end", "overlap") == want


def test_vision_is_strict(spark):
    windows = frame(spark, [("a", 0, 100)])
    points = spark.createDataFrame([("a", p) for p in range(100)], "key string, pos bigint")
    found = sorted(r["pos"] for r in iv.containment_join(windows, points, vision=0.5).collect())
    assert found == list(range(26, 75))


def test_majority_bins(spark):
    row = spark.range(1).select(iv.bins_touched(F.lit(60), F.lit(200), 128).alias("a"), iv.bins_touched(F.lit(60), F.lit(200), 128, False).alias("b")).first()
    assert row["a"] == [0, 1] and row["b"] == [0, 1]


def test_greedy_clusters(spark):
    df = spark.createDataFrame([("a", p) for p in (1, 3, 9, 11, 30)], "key string, pos bigint")
    assert spans(iv.greedy(df, 5), "first", "n") == [(1, 2), (9, 2), (30, 1)]


def test_disjoin(spark):
    df = spark.createDataFrame([("a", 0, 4, 2.0), ("a", 2, 6, 4.0)], "key string, start bigint, end bigint, value double")
    assert spans(iv.disjoin(df), "start", "end", "mean") == [(0, 2, 2.0), (2, 4, 3.0), (4, 6, 4.0)]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert iv.merge(none).count() == iv.rejoin(none).count() == iv.tile(none, 4, 2).count() == 0


def test_quota_split_covers_all_once_and_repeats_itself(spark):
    df = spark.createDataFrame([(f"c{k}", 1 + k * 37 % 91) for k in range(300)], "id string, size bigint")
    a = {r["id"]: r["split"] for r in sp.quota_split(df, {"train": 0.8, "valid": 0.1, "test": 0.1}).collect()}
    assert len(a) == 300 and a == {r["id"]: r["split"] for r in sp.quota_split(df, {"train": 0.8, "valid": 0.1, "test": 0.1}).collect()}
    sizes = {}
    for r in df.collect():
        sizes[a[r["id"]]] = sizes.get(a[r["id"]], 0) + r["size"]
    total = sum(sizes.values())
    assert abs(sizes["train"] / total - 0.8) < 0.05 and abs(sizes["valid"] / total - 0.1) < 0.05


def test_unsorted_rows_are_an_error(spark):
    good = spark.createDataFrame([(1, "a", 5), (2, "a", 7), (3, "b", 1)], "n int, key string, pos bigint")
    assert sp.assert_sorted(good, "n", "key", "pos").count() == 3
    for bad in ([(1, "a", 7), (2, "a", 5)], [(1, "a", 1), (2, "b", 1), (3, "a", 2)]):
        with pytest.raises(Exception, match="not sorted"):
            sp.assert_sorted(spark.createDataFrame(bad, "n int, key string, pos bigint"), "n", "key", "pos").collect()


def random_rows(n=200):
    rnd = random.Random(n)
    return [(rnd.choice("aaab"), s := rnd.randrange(n), s + rnd.randrange(1, 6)) for _ in range(n)]


def test_sweeps_over_several_tasks(spark):
    """With spread, a key's rows are in several parts; the results are the same."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = frame(spark, random_rows()).withColumn("value", (F.col("start") % 7).cast("double")).repartition(5)
    pieces = frame(spark, [(k, 3 * i, 3 * i + 3) for k in "ab" for i in range(60) if i % 9])
    starts = df.select("key", F.col("start").alias("pos")).distinct()
    low = F.col("pos") % 5 > 1
    for f in (
        lambda x: iv.merge(df, spread=x), lambda x: iv.merge(df, touching=False, spread=x), lambda x: iv.rejoin(pieces, spread=x),
        lambda x: iv.chain(starts, 2, spread=x), lambda x: iv.runs(starts, low, spread=x), lambda x: iv.disjoin(df, spread=x),
    ):
        one, many = f(False), f(True)
        assert sorted(map(repr, many.select(*one.columns).collect())) == sorted(map(repr, one.collect()))
    from lociframe.operators.ordered import dealt

    assert dealt(df, ["key"], "start", True).where("key = 'a'").select("__part").distinct().count() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
