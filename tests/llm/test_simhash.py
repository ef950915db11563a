import random

import numpy as np
import pytest
import xxhash

from lociframe.llm import simhash

SCHEMA = "doc_id bigint, text string, fp string"


def brute(rows, distance=4, words=4):
    def fp(text):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for b in "\t\n\x0b\x0c\r":
            t = t.replace(b, " ")
        w = [x for x in t.split(" ") if x]
        s = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))

    fps = [fp(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= distance and label[i] != label[j]:
                    label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
                    changed = True
    least = {}
    for (d, _), x in zip(rows, label):
        if d is not None:
            least[x] = min(d, least.get(x, d))
    return sorted(((d, f, least.get(x)) for (d, _), f, x in zip(rows, fps, label)), key=repr)


def got(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA)
    return sorted(((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_groups(df, **options).collect()), key=repr)


def corpus(seed=3, n=120):
    rnd = random.Random(seed)
    words = ["w%d" % i for i in range(300)]
    texts = [None, "", " \t\n", "One", "one", "ONE  two", "a b c d", "A b\tc\nd", "é É x y z"]
    while len(texts) < n:
        base = [rnd.choice(words) for _ in range(rnd.choice([5, 30, 300]))]
        for _ in range(rnd.choice([1, 1, 4])):
            copy = list(base)
            copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(" ".join(copy))
    rows = [(i * 3 % 997, t) for i, t in enumerate(texts)]
    return rows + [rows[9], (None, rows[20][1])]


def test_equals_brute_force(spark):
    rows = corpus()
    assert got(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert got(spark, []) == []


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 4, 6])
def test_no_link_is_lost_at_any_plan(spark, distance, monkeypatch):
    rnd = random.Random(distance)
    seeds = [rnd.getrandbits(64) for _ in range(40)]
    fps = {s ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(7))) for s in seeds for _ in range(8)}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp bigint")
    want = {frozenset((a, b)) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= distance}

    def classes(edges):
        parent = {x: x for x in fps}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in map(tuple, edges):
            parent[max(root(a), root(b))] = min(root(a), root(b))
        return [root(x) for x in fps]

    count, both = simhash.agreement(df)
    for m in range(1, min(4, distance + 1) + 1):
        groups = simhash.group_bits(count, both, m)
        thresholds = [distance + 1 - m] + [0] * (m - 1)
        if thresholds[0] > 2:
            continue
        for block in (4096, 5):
            monkeypatch.setattr(simhash, "plan", lambda *_: list(zip(groups, thresholds)))
            monkeypatch.setattr(simhash, "BLOCK", block)
            found = {frozenset((r["a"], r["b"])) for r in simhash.links(df, distance).collect()}
            assert found <= want
            assert classes(found) == classes(want)


def test_plan_meets_the_principle():
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 2, (500, 64)).astype(float)
    for count in (500, 10**6, 10**10):
        planned = simhash.plan(count, x.T @ x * (count / 500), 4)
        assert sorted(b for bits, _ in planned for b in bits) == list(range(64))
        assert sum(t for _, t in planned) == 4 - len(planned) + 1


def test_one_large_group_is_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    fps = [1 << a | 1 << b for a in range(20) for b in range(a)] + [-1, -2, 1 << 40 | 0xFFFFF]
    df = spark.createDataFrame([(x,) for x in fps], "fp bigint")
    stars = {r["u"]: r["v"] for r in simhash.components(simhash.links(df)).collect()}
    small = fps[:190]
    assert {stars.get(x, x) for x in small} == {min(small)}
    assert stars[-1] == -2 and fps[-1] not in stars


def edited(rnd, words, n):
    out = list(words)
    for i in rnd.sample(range(len(out)), n):
        out[i] = "x%d" % rnd.randrange(10**6)
    return out


def test_wide_fingerprints_catch_what_is_similar(spark):
    rnd = random.Random(5)
    rows, kind = [], {}
    for g in range(40):
        base = ["w%d" % rnd.randrange(5000) for _ in range(rnd.choice([80, 300]))]
        for k in range(3):
            kind[len(rows)] = g
            rows.append((len(rows), " ".join(edited(rnd, base, k * len(base) // 150))))  # at least 0.87 similar to the first
    rows += [(1000 + k, " ".join("w%d" % rnd.randrange(5000) for _ in range(60))) for k in range(200)]
    rows += [(2000, None), (2001, "")]
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA)
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df).collect()}
    for d, _ in rows:
        assert found[d] == (min(x for x in kind if kind[x] == kind[d]) if d in kind else min(d, 2000) if d > 1999 else d)
    kept = simhash.drop_similar(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(found.values()))
    assert simhash.drop_similar(df.where("false")).count() == 0


def test_doubtful_pairs_are_confirmed_on_their_texts(spark):
    """Pairs just above and below the similarity are told apart, and groups of over 400 rows hold doubtful pairs too."""
    rnd = random.Random(8)
    rows, pairs = [], []
    for g in range(150):
        base = ["w%d" % rnd.randrange(10**6) for _ in range(200)]
        near = edited(rnd, base, rnd.choice([2, 4, 5, 6, 8]))
        pairs.append((len(rows), len(rows) + 1))
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(near))]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows]
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA)
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df).collect()}
    similar = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in pairs}
    linked = {p for p in pairs if found[p[0]] == found[p[1]]}
    assert all(similar[p] >= 0.8 for p in linked if similar[p] < 0.79 or similar[p] >= 0.8)
    assert sum(similar[p] >= 0.8 for p in pairs) > 40 and sum(similar[p] < 0.8 for p in pairs) > 40
    missed = [p for p in pairs if similar[p] >= 0.8 and p not in linked]
    assert len(missed) <= 0.05 * sum(similar[p] >= 0.8 for p in pairs)
    assert not [p for p in linked if similar[p] < 0.78]


def test_doubtful_pairs_of_a_large_group():
    rnd = np.random.default_rng(2)
    fps = rnd.integers(0, 1 << 63, (500, 2)).astype("<u8")
    fps[1], fps[2] = fps[0] ^ np.array([1, 1], "<u8"), fps[0] ^ np.array([31, 0], "<u8")
    a, b, sure = simhash._verify(np.ones(500, int), np.ones(500, bool), fps, 2, 7)
    assert {(x, y): s for x, y, s in zip(a.tolist(), b.tolist(), sure.tolist())} in ({(0, 1): True, (0, 2): False}, {(0, 1): True, (2, 0): False})


def test_repeats_do_not_part_equal_shingle_sets(spark):
    rnd = random.Random(12)
    words = ["w%d" % rnd.randrange(10**6) for _ in range(1000)]
    often = words[:500] + 30 * words[400:500] + words[500:]  # the set has four shingles more
    rows = [(1, " ".join(words)), (2, " ".join(often)), (3, " ".join("v%d" % rnd.randrange(10**6) for _ in range(1000)))]
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA)
    assert sorted(r["doc_id"] for r in simhash.drop_similar(df).collect()) == [1, 3]


def test_near_links_are_confirmed_on_their_texts(spark, monkeypatch):
    """Links within the bits that are sure come out only where the sets are similar, and another link replaces one to
    the group's root that is not."""
    rnd = random.Random(13)
    base = ["w%d" % rnd.randrange(10**6) for _ in range(200)]
    texts = [base]
    for k in range(1, 8):  # each has 12 words unlike the one before, so only neighbours are similar
        texts.append([*texts[-1][: 12 * k], *("x%d" % rnd.randrange(10**6) for _ in range(12)), *texts[-1][12 * k + 12 :]])
    far = [*base[:150], *("y%d" % rnd.randrange(10**6) for _ in range(50))]  # 0.6 similar to the first
    rows = [(k, " ".join(t)) for k, t in enumerate([*texts, far])]
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA)
    real = simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps, distance, bits, planned, most, **more: real(fps, most + 60, bits, planned, most + 60, **more))
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df, recall=0.9).collect()} == {k: 8 if k == 8 else 0 for k in range(9)}


def test_ids_join_no_groups(spark):
    rnd = random.Random(14)
    texts = [" ".join("w%d" % rnd.randrange(10**6) for _ in range(60)) for _ in range(5)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (9, texts[4]), (None, texts[4])]
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA)
    assert sorted(((r["doc_id"], r["text"]) for r in simhash.drop_similar(df).collect()), key=repr) == sorted(rows[:5], key=repr)


@pytest.mark.parametrize("open_", [256, 3])
def test_rejected_links_of_a_large_group_are_replaced(spark, monkeypatch, open_):
    """All fingerprints meet in one group; the closest pairs are not similar, a farther one that they stand for is."""
    rnd = np.random.default_rng(15)
    words = [["w%d" % rnd.integers(10**9) for _ in range(100)] for _ in range(40)]
    words[2] = [*words[0][:98], "y", "z"]  # similar to the first
    texts = [" ".join(w) for w in words]
    fps = rnd.integers(0, 1 << 63, (40, 8)).astype("<u8")
    fps[:, 0] &= ~np.uint64(1)

    def flipped(fp, bits):
        out = simhash._single(fp[None])[0].copy()
        out[bits] ^= 1
        return np.packbits(out, bitorder="little").view("<u8")

    fps[1], fps[2] = flipped(fps[0], np.arange(1, 71)), flipped(fps[0], np.arange(30, 108))  # 70 bits from A to B, 78 to C, 66 from B to C
    of = dict(zip(texts, fps))

    def planted(docs, text, *_, **__):
        make = simhash.F.udf(lambda t: bytearray(of[t].tobytes()), "binary")
        return docs.withColumn("fp", make(text)).drop(text)

    monkeypatch.setattr(simhash, "fingerprints", planted)
    monkeypatch.setattr(simhash, "plan", lambda *_: [([0], 0)])
    monkeypatch.setattr(simhash, "OPEN", open_)
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], SCHEMA)
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df).collect()} == {k: 0 if k == 2 else k for k in range(40)}


def test_similar_pairs_equal_brute_force():
    rnd = np.random.default_rng(16)
    fps = rnd.integers(0, 16, (60, 8)).astype("<u8")
    sets = [np.unique(rnd.integers(0, 12, rnd.integers(1, 20))).astype("<u8") for _ in range(60)]
    root = [bytes([k // 2]) for k in range(60)]
    masks = [(np.array([3, 0, 0, 0, 0, 0, 0, 0], "<u8"), 0)]

    def classes(edges):
        label = [k // 2 for k in range(60)]
        for a, b in edges:
            label = [label[a] if x == label[b] else x for x in label]
        return {frozenset(k for k in range(60) if label[k] == x) for x in label}

    def similar(i, j):
        x, y = set(sets[i].tolist()), set(sets[j].tolist())
        return len(x & y) >= 0.8 * len(x | y) and simhash._apart(fps[i], fps[j]) <= 14 and (fps[i][0] ^ fps[j][0]) & np.uint64(3)

    found = simhash._similar_pairs(fps, sets, root, masks, 14, 0.8)
    want = [(i, j) for i in range(60) for j in range(i + 1, 60) if similar(i, j)]
    assert found and set(found) <= set(want) and classes(found) == classes(want)
