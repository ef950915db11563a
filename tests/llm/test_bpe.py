import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lociframe.llm import bpe, queries

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(open(PATH, "rb").read())


@pytest.fixture(scope="module")
def ours(ranks):
    return bpe.Codec(ranks, P.PATTERN)


@pytest.fixture(scope="module")
def theirs(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(codec, text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


@given(st.text(max_size=300))
@settings(max_examples=200, deadline=None)
def test_any_text(ours, theirs, text):
    assert ids(ours, text) == theirs.encode_ordinary(text)
    assert ours.decode(ours.encode(text)) == text.encode()


@given(st.binary(min_size=1, max_size=400))
@settings(max_examples=200, deadline=None)
def test_tree_equals_plain_merging(ours, data):
    assert ours.tree.encode(data) == ours.tree._merge_long(data) if data not in ours.tree.ranks else True
    assert ours.tree.decode(ours.tree.encode(data)) == data


@pytest.mark.parametrize("text", ["a" * 20000, "ab" * 9000, "=" * 7001, "the" * 5000, "日本" * 3000, " " * 5000 + "x", "<|endoftext|>"])
def test_long_pieces(ours, theirs, text):
    assert ids(ours, text) == theirs.encode_ordinary(text)


def test_small_vocabularies():
    rnd = random.Random(2)
    for _ in range(60):
        ranks = {bytes([b]): b for b in range(256)}
        for _ in range(rnd.randrange(1, 30)):
            a, b = rnd.choice(list(ranks)[97:100] + list(ranks)[256:]), rnd.choice(list(ranks)[97:100] + list(ranks)[256:])
            ranks.setdefault(a + b, len(ranks))
        tree = bpe.TreeBpe(ranks, leaf=4)
        for _ in range(20):
            data = bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, 120)))
            plain = tree._merge_short(data)
            assert tree._merge_long(data) == plain
            assert tree.encode(data) == ([ranks[data]] if data in ranks else plain)


def test_missing_bytes_are_an_error():
    with pytest.raises(ValueError, match="single bytes"):
        bpe.TreeBpe({b"a": 0})


def test_tables(spark, theirs):
    rows = [(1, None, "x"), (2, "", "y"), (3, "Hello  world's é\n\n!", "z"), (3, "Hello  world's é\n\n!", "z"), (None, "a" * 5000, "w")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    for packed in (False, True):
        done = bpe.encode(df, PATH, P.PATTERN, packed=packed, decoded="decoded").orderBy("doc_id", "n_tokens").collect()
        for r in done:
            want = theirs.encode_ordinary(r["text"] or "")
            got = np.frombuffer(r["ids"], "<u4").tolist() if packed else r["ids"]
            assert got == want and r["n_tokens"] == len(want) and bytes(r["decoded"]) == (r["text"] or "").encode()
    back = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert sorted(bytes(r["decoded"]).decode() for r in back) == sorted(t or "" for _, t, _ in rows)
    assert bpe.encode(df.where("false"), PATH, P.PATTERN).count() == 0


def test_query(spark, theirs):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op9_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for d, text in rows:
        want = theirs.encode_ordinary(text or "")
        assert got[d]["n_tokens"] == len(want)
        assert got[d]["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_ordinary_pieces_go_through_the_tree(ranks, theirs, spark):
    """Each piece of the table that is no token is joined from its parts, at least once."""
    codec = bpe.Codec(ranks, P.PATTERN)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r["text"]]
    assert [ids(codec, t) for t in texts] == theirs.encode_ordinary_batch(texts)
    pieces = {p.encode() for t in texts for p in codec.pieces.findall(t)}
    split = [p for p in pieces if p not in ranks]
    assert len(split) > 0.5 * len(pieces) and codec.tree.joins >= 0.5 * len(split)
    fresh = bpe.TreeBpe(ranks)
    for p in split[:300]:
        before = fresh.joins
        fresh._halves.clear()
        assert fresh.encode(p) == fresh._plain(p) and (fresh.joins > before) == (len(p) > 2)


def test_tokens_that_merging_does_not_yield():
    """The first merge in abcd is bc, after which no pair is a token; so the token abcd comes of the piece abcd only."""
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"ab": 257, b"abcd": 258, b"xabc": 259, b"da": 260}
    tree, theirs = bpe.TreeBpe(ranks), tiktoken.Encoding("odd", pat_str=r"[a-z]+", mergeable_ranks=ranks, special_tokens={})
    assert b"abcd" not in tree.parts and b"xabc" not in tree.parts and b"ab" in tree.parts
    rnd = random.Random(5)
    for data in [b"abcd", b"xabc", b"abcdabcd", *(bytes(rnd.choice(b"abcdx") for _ in range(rnd.randrange(1, 40))) for _ in range(2000))]:
        assert tree.encode(data) == theirs.encode_ordinary(data.decode())


def test_wrong_ids():
    tree = bpe.TreeBpe({bytes([b]): b for b in range(256)})
    assert tree.decode([]) == b"" and tree.decode([104, 105]) == b"hi"
    for wrong in (-1, 256):
        with pytest.raises(IndexError):
            tree.decode([wrong])
