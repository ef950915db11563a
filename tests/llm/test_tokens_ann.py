import random

import numpy as np
import pytest
import public_tokenizers as P
from pyspark.sql import functions as F

from lociframe.llm import ann, queries, token_counts
from lociframe.llm.bpe import read_ranks

PATH = P.path("byte_bpe_50k.tiktoken")


def greedy(word, opening, going_on):
    i = n = 0
    while i < len(word):
        pieces = opening if i == 0 else going_on
        j = next((j for j in range(len(word), i, -1) if word[i:j] in pieces), None)
        if j is None:
            return -1
        i, n = j, n + 1
    return n


def test_automaton_equals_greedy_matching():
    rnd = random.Random(1)
    word = lambda n: bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, n)))
    for _ in range(300):
        opening = {b" " + word(5) for _ in range(rnd.randrange(1, 12))} | ({b" "} if rnd.random() < 0.5 else set())
        going_on = {word(5) for _ in range(rnd.randrange(1, 14))}
        a = token_counts.Automaton(opening, going_on)
        for _ in range(40):
            w = b" " + word(14)
            assert a.count(w) == greedy(w, opening, going_on)


def test_counts(spark):
    opening, going_on = map(set, token_counts.split_vocabulary(read_ranks(open(PATH, "rb").read())))
    rows = [(1, None), (2, ""), (3, "Hello  world's é\n\tx"), (3, "Hello  world's é\n\tx"), (None, "a" * 5000 + " b"), (4, "a b c\x1cd")]
    df = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id bigint, text string, n_tokens int")
    got = sorted(((r["doc_id"] or 0, r["n_words"], r["n_tokens"], r["n_unknown"]) for r in token_counts.count_tokens(df, PATH).collect()))
    want = []
    for d, t in rows:
        words = (t or "").encode().split()
        want.append((d or 0, len(words), sum(greedy(b" " + w, opening, going_on) for w in words), 0))
    assert got == sorted(want)
    assert token_counts.count_tokens(df.where("false"), PATH).count() == 0


def test_count_query(spark):
    opening, going_on = map(set, token_counts.split_vocabulary(read_ranks(open(PATH, "rb").read())))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = queries.op8_token_counts(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts)
    known = {}
    for r in got:
        words = (texts[r["doc_id"]] or "").encode().split()
        for w in set(words) - set(known):
            known[w] = greedy(b" " + w, opening, going_on)
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(known[w] for w in words))


def exact(rows, asks, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    size = max({len(v) for _, v in good}, key=lambda n: sum(len(v) == n for _, v in good)) if good else 0
    good = sorted({(i, tuple(v)) for i, v in good if len(v) == size})
    out = []
    for q, v in good:
        if asks(q):
            v = np.array(v)
            near = sorted((-float(v @ np.array(w) / (np.linalg.norm(v) * np.linalg.norm(w))), i) for i, w in good if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return out


def test_neighbours_of_a_small_table_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=7)]) for k in range(120)]
    rows += [(200 + k, rows[10][1]) for k in range(12)] + [rows[10], rows[10], (300, None), (301, [0.0] * 7), (302, [float("nan")] + [1.0] * 6), (303, [1.0, 2.0]), (304, [None] + [1.0] * 6), (None, rows[3][1]), (310, [x * 3 for x in rows[20][1]])]
    df = spark.createDataFrame([(i, v, 0, "c") for i, v in rows], "vec_id bigint, embedding array<float>, label int, rank string")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = sorted(tuple(r) for r in ann.nearest(df, F.col("vec_id") % 10 == 0).collect())
    want = sorted(exact(rows, lambda i: i % 10 == 0))
    assert [(a, b) for a, b, _, _ in got] == [(a, b) for a, b, _, _ in want]
    assert np.allclose([s for *_, s in got], [s for *_, s in want], atol=1e-12)
    apart = [(g, w) for g, w in zip(got, want) if g[2] != w[2]]
    assert all(abs(g[3] - w[3]) < 1e-12 for g, w in apart)  # equal up to rounding


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert [(r["query_id"], r["vec_id"]) for r in ann.nearest(df, F.col("vec_id") == 0).collect()] == [(0, 1)]
    assert ann.nearest(df.where("vec_id = 0"), F.lit(True)).count() == 0
    assert ann.nearest(df.where("false"), F.lit(True)).count() == 0


def test_recall(spark):
    data = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = {(q, i) for q, _, i, _ in exact([(r[0], r[1]) for r in rows], lambda i: i % 50 == 0)}
    got = queries.op4_nearest(spark, data).collect()
    assert len(got) == len(want)
    assert len(want & {(r["query_id"], r["vec_id"]) for r in got}) / len(want) >= 0.9


def test_parallel_residuals_count_more():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    book = ann.fit(x, threshold=0.5)
    plain = ann.Codebook(book.words, 1.0)
    along = {}
    for name, b in (("score-aware", book), ("plain", plain)):
        c = b.codes(x)
        near = np.stack([b.words[m][c[:, m]] for m in range(8)], 1).reshape(len(x), -1)
        along[name] = np.mean(((x - near) * x).sum(1) ** 2)
    assert book.weight > 1 and along["score-aware"] < along["plain"]
    codes = book.codes(x)[:50]
    tables = ann.tables(x[:3], book)
    by_table = sum(tables[:, m][:, ann.packed(codes)[:, m]] for m in range(4))
    direct = np.einsum("qmd,nmd->qn", x[:3].reshape(3, 8, 2), np.stack([book.words[m][codes[:, m]] for m in range(8)], 1))
    assert np.allclose(by_table, direct, atol=1e-5)


def gathered(n, d=16, clusters=40, seed=9):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(clusters, d))
    return middle[rng.integers(0, clusters, n)] + 0.3 * rng.normal(size=(n, d))


def test_few_lists_are_scanned_where_vectors_form_clusters(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 100)
    x = gathered(3000)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    index = ann.fit_index(unit, len(x), 5, 0.985)
    assert len(index.middle) == 30 and index.probed <= 6
    assert ann.fit_index(unit, len(x), 5, None).probed == 30
    spread = np.random.default_rng(1).normal(size=(3000, 64))
    assert ann.fit_index(spread / np.linalg.norm(spread, axis=1, keepdims=True), 3000, 5, 0.985).probed > 15
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want = {(q, i) for q, _, i, _ in exact(rows, lambda i: i % 50 == 0)}
    got = {(r[0], r[2]) for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect()}
    assert len(want & got) / len(want) >= 0.95
    whole = {(r[0], r[2]) for r in ann.nearest(df, F.col("vec_id") % 50 == 0, recall=None).collect()}
    assert whole == want


@pytest.mark.parametrize("kind", ["one direction", "three clusters", "two dimensions", "queries apart", "one component"])
def test_recall_on_other_rows(spark, kind):
    """Vectors that codes of one level do not tell apart, and queries that the sample does not stand for."""
    rng, n = np.random.default_rng(6), 4000
    x = rng.normal(size=(n, 2 if kind == "two dimensions" else 16))
    if kind == "one direction":
        x += 20
    elif kind == "three clusters":
        x = rng.normal(size=(3, 16))[rng.integers(0, 3, n)] + 0.002 * x
    elif kind == "queries apart":
        x[::50] = 0.3 * x[::50] + 4
    elif kind == "one component":
        x = np.where(np.arange(16) == rng.integers(0, 16, (n, 1)), x, 0)  # cosines of 1 and 0: ids decide
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    want = {(q, i) for q, _, i, _ in exact(rows, lambda i: i % 50 == 0)}
    assert len(got) == len(want)
    assert len(want & {(r["query_id"], r["vec_id"]) for r in got}) / len(want) >= 0.97


def test_vectors_that_no_codes_tell_apart(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEVELS", (1,))
    x = np.random.default_rng(8).normal(size=(2000, 8)) + 100
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    want = {(q, i) for q, _, i, _ in exact(rows, lambda i: i % 50 == 0)}
    assert {(r["query_id"], r["vec_id"]) for r in got} == want


def test_very_large_and_small_components(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 1e-200]), (2, [3e200, 0.0]), (3, [-1.0, 1.0]), (4, [1e308, 1e308])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for recall in (0.985, None):
        got = [(r["vec_id"], r["score"]) for r in ann.nearest(df, F.col("vec_id") == 0, recall=recall).orderBy("rank").collect()]
        assert [i for i, _ in got] == [1, 4, 2, 3] and np.allclose([s for _, s in got], [1, 1, 0.5**0.5, 0], atol=1e-12)
