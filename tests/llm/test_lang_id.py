import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from lociframe.llm import lang_id, queries


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    e, moves = rng.normal(size=(3, 5, 3)), rng.normal(size=(3, 3))
    mask = np.array([[1] * 5, [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], bool)
    found, expected = lang_id.forward_backward(e, mask, moves, True)
    total_moves = np.zeros((3, 3))
    for c in range(3):
        n = int(mask[c].sum())
        total, marginal, moved = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=n):
            w = np.exp(sum(e[c, t, path[t]] for t in range(n)) + sum(moves[path[t], path[t + 1]] for t in range(n - 1)))
            total += w
            for t in range(n):
                marginal[t, path[t]] += w
            for t in range(n - 1):
                moved[path[t], path[t + 1]] += w
        assert np.allclose(found[c, :n], marginal / total)
        total_moves += moved / total
    assert np.allclose(expected, total_moves)


def texts(n=60, seed=1):
    rnd = random.Random(seed)
    parts = {"xx": ["ka", "ko", "tak", "ro"], "yy": ["ing", "the", "sh", "ed"], "zz": ["ßen", "ü", "sch", "ver"]}
    return [(lang, " ".join("".join(rnd.choice(p) for _ in range(rnd.randrange(1, 4))) + rnd.choice(["", ",", "."]) for _ in range(rnd.randrange(3, 80)))) for lang, p in parts.items() for _ in range(n)]


def test_words_of_switched_text_are_labelled():
    field = lang_id.fit(texts())
    a, b = [t for lang, t in texts(seed=2) if lang == "xx"][0], [t for lang, t in texts(seed=2) if lang == "zz"][1]
    words = [lang_id.core(w) for w in (a + " " + b).split()]
    e = field.emissions(words)
    found, _ = lang_id.forward_backward(e[None], np.ones((1, len(words)), bool), field.moves)
    assert found[0, : len(a.split())].argmax(1).mean() < 0.1 and (found[0, len(a.split()) :].argmax(1) == 2).mean() > 0.9


def test_core_and_features():
    assert [lang_id.core(w) for w in ("Word,", "(É)", "123", "", "a1b", "--")] == ["word", "é", "", "", "a1b", ""]
    owner, ids, values = lang_id.features(["ab", "abcdef", "x" * 10_000], {"ab": [1]})
    assert set(owner.tolist()) == {0, 1, 2} and ids.max() == lang_id.WIDTH + 1 and values.min() > 0


def test_long_texts_are_read_whole():
    field = lang_id.fit(texts())
    xx, zz = " ".join(t for k, t in texts(seed=3) if k == "xx"), " ".join(t for k, t in texts(40, seed=3) if k == "zz")
    pred, score = lang_id.Reader(field).label([xx + " " + zz * 3, "ka", None, "", "12 --", zz])
    assert pred[0] == "zz" and pred[2:5] == ["und"] * 3 and score[2:5] == [0.0] * 3 and pred[5] == "zz"
    share = len(zz.split()) * 3 / (len(zz.split()) * 3 + len(xx.split()))
    assert abs(score[0] - share) < 0.05 and all(0 <= s <= 1 for s in score)


def test_tables(spark):
    rows = [(k, t, lang, "clash") for k, (lang, t) in enumerate(texts())]
    rows += [(900, None, "xx", "c"), (901, "", None, "c"), (902, "?!", "yy", "c"), (None, "the shed", "yy", "c"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string")
    done = lang_id.identify(df, learn=F.col("doc_id").isNotNull()).collect()
    assert len(done) == len(rows)
    pred = {r["doc_id"]: r["lang_pred"] for r in done}
    assert all(pred[k] == lang for k, _, lang, _ in rows[:180]) and pred[900] == pred[901] == pred[902] == "und" and pred[None] == "yy"
    kept = lang_id.keep_known(df, lang_id.fit(lang_id.sample(df, "doc_id", "text", "lang", F.lit(True))))
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    assert lang_id.identify(df.where("false")).count() == 0
    nothing = lang_id.identify(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
    assert lang_id.keep_known(df, lang_id.fit([])).count() == len(rows) - 3


def test_held_out_accuracy(spark):
    got = queries.op10_lang_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97


def test_every_language_is_learned(spark):
    rows = [(k, f"word{k} other", f"l{k % 120 if k % 2 else 0}") for k in range(960)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {lang for lang, _ in lang_id.sample(df, "doc_id", "text", "lang", F.lit(True))} == {lang for *_, lang in rows}
    df = spark.createDataFrame([(k, "a b", f"l{k}") for k in range(130)], df.schema)
    assert len({lang for lang, _ in lang_id.sample(df, "doc_id", "text", "lang", F.lit(True))}) == 130
