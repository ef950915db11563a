"""Tails, sweeps, readers and groups against plain versions."""

import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociframe.operators import graph, intervals, metrics, models, quantiles, splits
from lociframe.operators.alignments import tail_threshold
from lociframe.sources import examples, records


def tail(k, rate):
    """P(X >= k), summed in decimal logarithms of terms."""
    term = lambda i: math.exp(i * math.log(rate) - rate - math.lgamma(i + 1))
    width = int(40 * math.sqrt(rate) + 200)
    if k > rate:
        return math.fsum(term(i) for i in range(k, k + width))
    return 1 - math.fsum(term(i) for i in range(max(0, k - width), k))


def test_poisson_tail(spark):
    cases = [(0, 3.0), (1, 0.001), (1, 5.0), (30, 4.0), (401, 300.0), (500, 420.0), (700, 500.0), (745, 746.0), (900, 800.0), (10_200, 1e4), (9_800, 1e4), (101_000, 1e5), (99_000, 1e5), (1_003_000, 1e6), (1_000_000, 1e6), (5, 0.0), (0, 0.0), (50, 2000.0)]
    df = spark.createDataFrame([(k, float(r)) for k, r in cases], "k bigint, r double").withColumn("p", metrics.poisson_tail(F.col("k"), F.col("r")))
    for k, rate, p in df.collect():
        want = 1.0 if k <= 0 else 0.0 if rate == 0 else tail(k, rate)
        assert p == pytest.approx(want, rel=1e-6, abs=1e-15), (k, rate)
    at = {(k, r): p for k, r, p in df.collect()}
    assert at[500, 420.0] == pytest.approx(8.05e-5, rel=0.01) and 0 < at[700, 500.0] < 1e-12 and at[1, 0.001] == pytest.approx(-math.expm1(-0.001))


def test_tail_threshold():
    for rate in (0.01, 0.5, 3.0, 80.0, 900.0):
        k = tail_threshold(rate)
        assert tail(k, rate) <= 0.01 < tail(k - 1, rate) if k > 1 else tail(k, rate) <= 0.01
    assert tail_threshold(0.0) == 1


@pytest.mark.parametrize("spread", [False, True])
def test_folded_clusters(spark, spread):
    rnd = random.Random(6)
    rows = [(rnd.choice(["a", "b", None]), rnd.randrange(400)) for _ in range(300)] + [("c", 5), ("c", 5), ("d", 10_000)]
    df = spark.createDataFrame(rows, "key string, pos bigint")
    firsts, means = [], []
    for key in {k for k, _ in rows}:
        at = sorted(p for k, p in rows if k == key)
        first, n, total, m = at[0], 0, 0, 0
        for p in at:
            if p >= first + 25:
                firsts.append((key, first, n))
                first, n = p, 0
            n += 1
            if m and p - total / m > 6:
                means.append((key, round(total / m, 9), m))
                total = m = 0
            total, m = total + p, m + 1
        firsts.append((key, first, n))
        means.append((key, round(total / m, 9), m))
    assert sorted(map(repr, firsts)) == sorted(repr(tuple(r)) for r in intervals.greedy(df, 25, spread=spread).collect())
    got = [(r["key"], round(r["mean"], 9), r["n"]) for r in intervals.running_mean_clusters(df, 6, spread=spread).collect()]
    assert sorted(map(repr, means)) == sorted(map(repr, got))
    assert intervals.greedy(df.where("false"), 25, spread=spread).count() == 0


@pytest.mark.parametrize("spread", [False, True])
def test_without_overlaps(spark, spread):
    rnd = random.Random(8)
    rows = [(rnd.choice("ab"), rnd.randrange(6), s, s + rnd.choice([1, 1, 3, 9])) for s in (rnd.randrange(150) for _ in range(120))]
    df = spark.createDataFrame(rows, "key string, owner int, start bigint, `end` bigint")
    want = [r for r in rows if not any(q[0] == r[0] and q[1] != r[1] and q[2] < r[3] and r[2] < q[3] for q in rows)]
    assert sorted(want) == sorted(tuple(r) for r in intervals.without_overlaps(df, spread=spread).select("key", "owner", "start", "end").collect())


def test_subtract_leaves_untouched_spans(spark):
    spans = spark.createDataFrame([("a", 0, 10), ("b", 0, 10), ("c", 0, 10)], "key string, start bigint, `end` bigint")
    holes = spark.createDataFrame([("a", 2, 4), ("a", 3, 5), ("a", 9, 20), ("b", 30, 40)], "key string, start bigint, `end` bigint")
    assert sorted(tuple(r) for r in intervals.subtract(spans, holes).collect()) == [("a", 0, 2), ("a", 5, 9), ("b", 0, 10), ("c", 0, 10)]


@pytest.mark.parametrize("spread", [False, True])
def test_percentiles(spark, spread):
    rnd = random.Random(9)
    rows = [(rnd.choice("ab"), rnd.choice([1.5, 2.0, rnd.random() * 9])) for _ in range(300)] + [("a", None), ("c", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in quantiles.wide(df, ["g"], "v", {"x": 0.25, "y": 0.9, "z": 1.0}, spread).collect()}
    for g in "abc":
        held = [v for k, v in rows if k == g and v is not None]
        assert [got[g][c] for c in "xyz"] == pytest.approx([np.percentile(held, p) for p in (25, 90, 100)])
    whole = [v for _, v in rows if v is not None]
    assert quantiles.wide(df, [], "v", {"x": 0.3}, spread).first()[0] == pytest.approx(np.percentile(whole, 30))


def test_unsorted_rows_are_an_error(spark):
    rows = [(0, "a", 1), (1, "a", 5), (2, "b", 2), (3, "b", 2)]
    schema = "n bigint, k string, p bigint"
    df = spark.createDataFrame(rows, schema)
    assert sorted(map(tuple, splits.assert_sorted(df, "n", "k", "p").collect())) == rows
    for wrong in ([*rows, (4, "b", 1)], [*rows, (4, "a", 9)]):
        with pytest.raises(Exception, match="not sorted"):
            splits.assert_sorted(spark.createDataFrame(wrong, schema), "n", "k", "p").collect()


def test_places_of_many_chromosomes(spark, monkeypatch):
    laid = intervals.offsets(spark.createDataFrame([("a", 10), ("b", 5), ("c", 7)], "key string, length bigint"))
    places = spark.createDataFrame([(p, "x") for p in (0, 9, 10, 14, 15, 21, 22, -1)], "place bigint, note string")
    want = {0: ("a", 0), 9: ("a", 9), 10: ("b", 0), 14: ("b", 4), 15: ("c", 0), 21: ("c", 6)}
    for few in (intervals.FEW, 1):
        monkeypatch.setattr(intervals, "FEW", few)
        got = intervals.from_offset(places, laid).collect()
        assert {r["place"]: (r["key"], r["pos"]) for r in got} == want and all(r["note"] == "x" for r in got)


def test_communities(spark):
    rnd = random.Random(3)
    n, size = 3, 6
    edges = [(a, b, 1.0) for a in range(n * size) for b in range(a) if rnd.random() < (0.95 if a // size == b // size else 0.02)]
    found = {r["node"]: r["community"] for r in graph.communities(spark.createDataFrame(edges, "a bigint, b bigint, w double").coalesce(1), rounds=4, levels=2).collect()}
    groups = {}
    for node, c in found.items():
        groups.setdefault(c, set()).add(node)
    assert sorted(map(sorted, groups.values())) == [list(range(k * size, (k + 1) * size)) for k in range(n)]
    assert all(c == min(g) for c, g in groups.items())


def test_factors(spark):
    rng = np.random.default_rng(2)
    a, b = rng.random((20, 2)), rng.random((15, 2))
    cells = [(i, j, float(a[i] @ b[j])) for i in range(20) for j in range(15)]
    x, y = models.factorised(spark.createDataFrame(cells, "i int, j int, v double"), "i", "j", "v", 2, 20, 1e-4)
    p, q = ({r[0]: np.array(r[1]) for r in t.collect()} for t in (x, y))
    assert min(v.min() for v in [*p.values(), *q.values()]) >= 0
    assert np.mean([abs(p[i] @ q[j] - v) for i, j, v in cells]) < 0.02


def test_negatives(spark):
    df = spark.range(50).withColumn("s", F.concat(F.lit("s"), F.col("id").cast("string")))
    assert examples.negatives(df, 50).count() == 50
    got = examples.negatives(df, 20).collect()
    assert sorted(r["draw"] for r in got) == list(range(20)) and all(r["s"] == f"s{r['id']}" for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, examples.negatives(df.repartition(7), 20).collect()))


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, data):
    return varint(number << 3 | 2) + varint(len(data)) + data


def message(features):
    made = b""
    for name, (kind, value) in features.items():
        if kind == "bytes":
            held = field(1, b"".join(field(1, v) for v in value))
        elif kind == "floats":
            held = field(2, field(1, struct.pack(f"<{len(value)}f", *value)))
        else:
            held = field(3, field(1, b"".join(varint(v % (1 << 64)) for v in value)))
        made += field(1, field(1, name.encode()) + field(2, held))
    return field(1, made)


def frames(messages):
    return b"".join(struct.pack("<QI", len(m), 1) + m + struct.pack("<I", 2) for m in messages)


@pytest.mark.parametrize("packed", [False, True])
def test_tfrecords(spark, tmp_path, packed):
    hot = np.eye(4, dtype=np.uint8)[[0, 3, 1]].tobytes() + bytes(4)
    target = np.array([[1, 2], [3, 4.5]], "<f2").tobytes()
    data = frames([message({"sequence": ("bytes", [hot]), "target": ("bytes", [target]), "n": ("ints", [3, -1]), "f": ("floats", [0.5])})] * 70)
    (tmp_path / "t-0.tfr").write_bytes(zlib.compress(data) if packed else data)
    rows = records.read(spark, f"file://{tmp_path}")
    assert rows.count() == 70
    one = rows.where("record = 69").first()["features"]
    assert one["n"]["ints"] == [3, -1] and one["f"]["floats"] == [0.5] and bytes(one["sequence"]["bytes"][0]) == hot
    made = records.examples(rows, 2).first()
    assert made["seq"] == "ATCN" and made["targets"] == [[1.0, 2.0], [3.0, 4.5]]
    with pytest.raises(ValueError, match="cut short"):
        list(records.framed(data[:-1]))


def test_rna_records(spark, tmp_path):
    one = message({"lengths": ("ints", [3]), "sequence": ("bytes", [bytes([2, 0, 3])]), "coding": ("bytes", [bytes([1, 0, 0])]), "splice": ("bytes", [bytes([0, 0, 1])]), "targets": ("bytes", [np.array([1.5], "<f2").tobytes()])})
    (tmp_path / "r.tfr").write_bytes(frames([one]))
    row = records.rna(records.read(spark, f"file://{tmp_path}"), 5).first()
    assert row["length"] == 3 and row["seq"] == "GATNN" and row["coding"] == [1, 0, 0, 0, 0] and row["splice"] == [0, 0, 1, 0, 0] and row["targets"] == [1.5]


def test_score_lookup_takes_the_last(spark):
    scores = spark.createDataFrame([("a", 0, 1.0), ("a", 3, 2.0), ("b", 1, 3.0)], "snp_id string, snp_index bigint, value double")
    asked = spark.createDataFrame([("a",), ("z",)], "snp_id string")
    assert [tuple(r) for r in examples.lookup(scores, asked).select("snp_id", "value").collect()] == [("a", 2.0)]
