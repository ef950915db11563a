import math

import pytest
from pyspark.sql import functions as F

from lociframe.operators import alignments as al
from lociframe.operators import contacts as ct
from lociframe.operators import graph
from lociframe.operators import metrics as mt
from lociframe.operators import models as md
from lociframe.operators import ordered
from lociframe.operators import scores as sc
from lociframe.operators import signal as sg


def test_unknown_statistics_raise(spark):
    with pytest.raises(ValueError, match="unknown"):
        sg.pool(F.lit(1.0), "mode")
    with pytest.raises(ValueError, match="unknown"):
        sc.effect_scores(spark.range(1), ["id"], stats=["SAD", "XYZ"])


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("g", p) for p in (0.01, 0.02, 0.03, 0.5)], "g string, p double")
    right = [round(r["q"], 9) for r in mt.benjamini_hochberg(df, ["g"]).orderBy("p").collect()]
    assert right == [0.04, 0.04, 0.04, 0.5]
    assert [r["q"] for r in mt.benjamini_hochberg(df, ["g"], legacy=True).orderBy("p").collect()] == [0, 0, 0, 0]


def test_no_variance_is_no_error(spark):
    df = spark.createDataFrame([("g", 1.0, 2.0), ("g", 2.0, 2.0)], "g string, y double, p double")
    row = mt.accuracy(df, ["g"], "y", "p").first()
    assert row["pearsonr"] == 0.0 and row["r2"] == 1 - 1.0 / 0.5


@pytest.mark.parametrize("spread", [False, True])
def test_ranks_of_large_keys(spark, spread):
    df = spark.createDataFrame([("g", float(x)) for x in (3, 1, 3, 2, 3)], "g string, v double")
    got = sorted((r["v"], r["n"], r["rank"]) for r in ordered.mid_ranks(df, ["g"], "v", spread).collect())
    assert got == [(1.0, 1, 1.0), (2.0, 1, 2.0), (3.0, 3, 4.0)]


@pytest.mark.parametrize("spread", [False, True])
def test_auc(spark, spread):
    rows = [("g", bool(k % 3 == 0), float(k * 7 % 11)) for k in range(40)]
    df = spark.createDataFrame(rows, "g string, y boolean, s double")
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(mt.auroc(df, ["g"], "y", "s", spread).first()["auroc"] - want) < 1e-12
    levels, ap = sorted({s for _, _, s in rows}, reverse=True), 0.0
    for x in levels:
        hit = sum(1 for s in pos if s == x)
        ap += hit / len(pos) * sum(1 for s in pos if s >= x) / sum(1 for _, _, s in rows if s >= x)
    assert abs(mt.auprc(df, ["g"], "y", "s", spread).first()["auprc"] - ap) < 1e-12


def test_auc_of_one_class(spark):
    df = spark.createDataFrame([("g", False, 1.0)], "g string, y boolean, s double")
    assert mt.auroc(df, ["g"], "y", "s").first()["auroc"] == 0.5 and mt.auprc(df, ["g"], "y", "s").first()["auprc"] == 0.0


def test_poisson_tail(spark):
    for k, rate in ((0, 2.0), (1, 2.0), (5, 2.0), (30, 20.0)):
        want = 1 - sum(math.exp(-rate) * rate**i / math.factorial(i) for i in range(k))
        got = spark.range(1).select(mt.poisson_tail(F.lit(k), F.lit(rate)).alias("p")).first()["p"]
        assert abs(got - max(0.0, want)) < 1e-12


def test_student_t():
    assert abs(mt.student_t_sf(2.0, 10) - 0.036694) < 1e-5
    assert abs(mt.student_t_sf(-2.0, 10) - (1 - 0.036694)) < 1e-5
    assert mt.student_t_sf(0.0, 5) == 0.5


def test_soft_clip_is_undone(spark):
    from lociframe.functions.transforms import untransform_exact

    x = F.col("id").cast("double")
    y = untransform_exact(sg.soft_clip(sg.damped(x), 5), F.lit(5.0), F.lit(True))
    assert spark.range(200).where(F.abs(y - x) > 1e-9).count() == 0


def test_interpolation(spark):
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate([None, 1.0, None, None, 4.0, None])], "key string, pos int, value double")
    assert [r["value"] for r in sg.interpolated(df).orderBy("pos").collect()] == [0.0, 1.0, 2.0, 3.0, 4.0, 0.0]


def test_contact_maps(spark):
    tri = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 1, 3.0)], "i int, j int, value double")
    full = ct.filled(tri, [])
    assert {(r["i"], r["j"]): r["value"] for r in full.collect()} == {(0, 0): 1, (0, 1): 2, (1, 0): 2, (1, 1): 3}
    assert {(r["i"], r["j"]): r["value"] for r in ct.symmetric(full, []).collect()} == {(0, 0): 1, (0, 1): 2, (1, 0): 2, (1, 1): 3}
    square = spark.createDataFrame([(i, j, 1.0) for i in range(6) for j in range(6)], "i int, j int, value double")
    packed = ct.packed_index(square, 6, 2)
    assert sorted(r["k"] for r in packed.collect()) == list(range(10))
    assert all(abs(r["value"] - 1) < 1e-12 for r in ct.blurred(square, [], 1.0).collect())


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (5, 5), (None, 7)]
    nodes = spark.createDataFrame([(k,) for k in [*range(1, 41), 100, 101, 200]], "node bigint")
    got = {r["node"]: r["component"] for r in graph.labelled(nodes, spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100, 200: 200}


def test_em_keeps_each_read_whole(spark):
    rows = [("r1", "c", 1), ("r1", "c", 9), ("r2", "c", 1), ("r3", "c", 1), ("r4", "c", 9), ("r4", "c", 20)]
    done = al.distribute_multi(spark.createDataFrame(rows, "read_id string, chrom string, pos bigint"))
    total = {r["read_id"]: r["w"] for r in done.groupBy("read_id").agg(F.sum("weight").alias("w")).collect()}
    assert all(abs(v - 1) < 1e-9 for v in total.values()) and len(total) == 4
    weights = {(r["read_id"], r["pos"]): r["weight"] for r in done.collect()}
    assert weights["r1", 1] > weights["r1", 9]


def test_poisson_thresholds():
    assert al.tail_threshold(1.0) == 5
    clips = al.adaptive_clips(most=6)
    assert [k for _, k in clips] == [2, 3, 4, 5, 6] and all(a < b for (a, _), (b, _) in zip(clips, clips[1:]))


def test_models(spark):
    df = spark.range(400).select("id", (F.col("id") % 2).cast("double").alias("y"), (F.col("id") % 2 + F.col("id") % 7 / 10).alias("x"))
    assert all(r["auroc"] > 0.99 for r in md.forest_auroc(df, ["x"], "y", "id", folds=2, trees=3, depth=3).collect())
    assert all(r["auroc"] > 0.99 for r in md.ridge_auroc(df, ["x"], "y", "id", folds=2, alpha=0.01).collect())
    assert all(r["auroc"] > 0.99 for r in md.score_auroc(df, "y", "x", "id", folds=2).collect())
    assert all(r["pearsonr"] > 0.9 for r in md.forest_accuracy(df, ["x"], "y", "id", folds=2, trees=3, depth=3).collect())


def test_grid_has_its_points():
    points = sc.grid()
    assert len(points) == 279 and points == sorted(set(points)) and points[0] == 0.001 and points[-1] == 0.999


def test_nearest_in_blocks(spark):
    import numpy as np

    x = np.random.default_rng(4).normal(size=(60, 5))
    x[7] = x[3] * 2
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(99, None)], "id bigint, v array<double>")
    c = np.round((x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)), 12)
    want = {(a, b, r + 1) for a in range(60) for r, b in enumerate(sorted((b for b in range(60) if b != a), key=lambda b: (-c[a, b], b))[:3])}
    for block in (2048, 16):
        assert {(r["a"], r["b"], r["rank"]) for r in graph.nearest(df, "id", "v", 3, block).collect()} == want
