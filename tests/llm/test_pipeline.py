"""The pipeline against a plain version of it, on documents with planted cases."""

import random
import re

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from lociframe.llm.bpe import read_ranks


def documents():
    rnd = random.Random(11)
    vocabulary = {"en": ["the", "and", "ing", "ther", "on", "ed"], "fr": ["le", "qué", "eau", "ment", "un", "ré"]}
    rows, kind = [], {}

    def words(lang, n):
        return ["".join(rnd.choice(vocabulary[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(n)]

    for g in range(60):
        lang = rnd.choice(["en", "fr"])
        base = words(lang, rnd.choice([120, 300]))
        near = list(base)
        near[rnd.randrange(len(near))] = "zzz"
        for text in (" ".join(base), "  ".join(base), " ".join(near)):
            kind[len(rows)] = g
            rows.append((len(rows), text, lang, f"src{g % 4}", len(text)))
    for text in (None, "", "  ", "123 !?", "\n"):
        rows.append((len(rows), text, None, "src0", 0))
    rows.append(rows[7])
    rows.append((None, " ".join(words("en", 80)), "en", None, 5))
    return rows, kind


def test_equals_plain_version(spark, tmp_path):
    rows, kind = documents()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read()), special_tokens={})
    want = {}
    for d, text, lang, source, _ in rows:
        if not re.search(r"[^\W\d_]", text or ""):
            continue
        first = [x for x in rows if x[0] is not None and kind.get(x[0]) == kind.get(d)] if d in kind else [(d, text)]
        want[min(x[0] for x in first) if d in kind else d] = None
    exact = {}  # of equal texts the longest stays, so of each group the doubled spaces and the edited copy meet, the smaller id stays
    for d, text, *_ in rows:
        if d in kind:
            exact.setdefault(kind[d], {}).setdefault(re.sub(r"\s", "", text), []).append((-len(text), d))
    kept = {min(min(same)[1] for same in texts.values()) for texts in exact.values()} | {None}
    assert set(got) == kept
    by_id = {r[0]: r for r in rows}
    for d, r in got.items():
        ids = encoding.encode_ordinary(by_id[d][1])
        assert r["n_tokens"] == len(ids) and r["source"] == by_id[d][3]


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, " ".join("w%d" % rng.randrange(10**6) for _ in range(50)), "en" if k % 2 else "fr", f"s{k % 3}", 1) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() == 200


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "byte_bpe"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_rows_carry_their_place_in_the_mix(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, " ".join("w%d" % rng.randrange(10**6) for _ in range(50)), "en", "books" if k < 60 else "web", 1) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    placed, slots = corpus_pipeline.mixing.mix(docs, corpus_pipeline.queries.SOURCE_WEIGHTS)
    want = [r["doc_id"] for r in placed.orderBy("slot", "place").collect()]
    assert slots > 4 and len({r["position"]["part"] for r in got}) > 1
    assert [r["doc_id"] for r in sorted(got, key=lambda r: tuple(r["position"]))] == want
