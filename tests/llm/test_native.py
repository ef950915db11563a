"""URL filters, exact dedup and mixing against brute force; their plans hold no Python."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lociframe.llm import exact_dedup, mixing, queries, repeats, simhash, url_filter


def no_python(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", text)


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    rest = re.split("[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


URLS = [
    None, "", "no url", "https://", "http://com/en/", "http://COM/en/x", "http://com/EN/x", "http://a.com/en/1", "http://xcom/en/1", "http://example.com/en/7", "http://www.Example.com/en/77?x#y",
    "http://badexample.com/en/7", "http://example.net/de/8", "http://example.net/de/9", "http://sub.example.net/de/81", "ftp://x.org/es/", "http://x.org/es", "http://x.org#/es/", "http://x.org?/es/", "http://cheap-pills.example.org/fr/1",
    "http://x.fr/a/casino/b", "http://com:80/en/1", "http://É.com/en/ä", "http://a://com/en/", "http://.com/en/", "x://com/en/é\n", "http://casino.fr/",
]


def test_urls_equal_brute_force(spark):
    rules = [url_filter.Rule(f"||{r}", a, 2) for r, a in queries.URL_RULES] + [url_filter.parse(p) for p in queries.URL_PATTERNS]
    df = spark.createDataFrame([(k, u, "clash", "clash") for k, u in enumerate(URLS + URLS[:3])], "page_id int, url string, host string, __best string")
    done = url_filter.judge(df.drop("__best"), rules)
    no_python(done)
    for r in done.collect():
        host, path = url_parts(r["url"])
        fits = [(len(x), x, a) for x, a in queries.URL_RULES for h, _, p in [x.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        assert (r["host"], r["path"]) == (host, path)
        if fits:
            assert (r["rule"], r["action"], r["rule_priority"]) == (*max(fits)[1:], 2)
        else:
            block = bool(host) and (any(l in ("cheap-pills", "spam-farm", "casino", "casino-win", "free-bets", "ads-track") for l in host.split(".")[:-1]) or "/casino/" in host + path)
            assert r["action"] == ("block" if block else "allow"), r
            assert r["rule_priority"] in (None, 0, 1)


def test_only_candidates_are_tried(spark):
    rules = [url_filter.Rule("||a.com/x", "block"), url_filter.Rule("||b.com/x", "block"), url_filter.Rule("zz", "block")]
    df = spark.createDataFrame([("http://a.com/x",), ("http://q.com/azzb",), ("http://q.com/",)], "url string")
    counts = url_filter.token_counts(df, "url", {"a", "b", "com", "x"})
    assert counts == {"a": 1, "com": 3, "x": 1}
    filed, loose = url_filter.index(rules, counts)
    assert [f["token"] for f in filed] == ["a", "b"] and [x["rule"] for x in loose] == ["zz"]
    assert [r["action"] for r in url_filter.judge(df, rules).collect()] == ["block", "block", "allow"]
    assert [r["action"] for r in url_filter.judge(df, []).collect()] == ["allow"] * 3
    assert url_filter.judge(df.where("false"), rules).count() == 0


def test_rule_syntax(spark):
    lines = ["! a comment", "", "||ads.example^", "@@||ads.example^ok/", "|www.start.", "/end|", "/a*z/", "^sep^", "/CaSe/", "||x.y/p|"]
    rules = [r for r in map(url_filter.parse, lines) if r]
    assert [r.priority for r in rules] == [0, 1, 0, 0, 0, 0, 0, 0]
    want = {
        "http://ads.example/": "block", "http://sub.ads.example:80/x": "block", "http://ads.example.com/": "allow", "http://ads.example/ok/1": "allow", "http://badads.example/": "allow",
        "http://www.start.com/": "block", "http://q.www.start.com/": "allow", "http://q/end": "block", "http://q/end/": "allow", "http://q/a/b/z/": "block", "http://q/az/": "block", "http://q/a/z": "allow",
        "http://q/sep": "block", "http://q/sep=1": "block", "http://q/xsep": "allow", "http://q/sep-1": "allow", "http://q/case/": "allow", "http://q/CaSe/": "block", "http://w.x.y/p": "block", "http://w.x.y/p/q": "allow",
    }
    got = url_filter.judge(spark.createDataFrame([(u,) for u in want], "url string"), rules).collect()
    assert {r["url"]: r["action"] for r in got} == want
    assert all(re.search(r.regex, u.split("//")[1]) is None or r.tokens <= set(re.split("[^a-z0-9]+", u.split("//")[1].lower())) for r in rules for u in want)


@pytest.mark.parametrize("inline", [20_000, 500])
def test_thousands_of_rules(spark, monkeypatch, inline):
    """Each URL runs few of them, whether they are constants or a table; the results are those of running all."""
    monkeypatch.setattr(url_filter, "INLINE", inline)
    rnd = random.Random(12)
    words = [f"w{k}" for k in range(900)]
    lines = [rnd.choice(["||{a}.{b}^", "/{a}/{b}^", "||{a}.com/{b}", "@@||{a}.com^{b}^", "/{a}-{b}|"]).format(a=rnd.choice(words), b=rnd.choice(words)) for _ in range(4000)] + ["0z0"]
    rules = [url_filter.parse(x) for x in lines]
    urls = [rnd.choice(["http://{a}.com/{b}", "http://m.{a}.{b}/x", "http://q.org/{a}/{b}?x", "http://q.org/{a}-{b}", "http://{a}.com/{b}/{a}"]).format(a=rnd.choice(words[:80]), b=rnd.choice(words[:300])) for _ in range(400)] + [None, "", "http://a0z0b/"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "id int, url string")
    done = url_filter.judge(df, rules)
    no_python(done)
    compiled = [(r, re.compile(r.regex)) for r in rules]
    for r in done.collect():
        target = "".join(url_parts(r["url"]))
        fits = [(x.priority, len(x.literal), x.literal, x.action) for x, c in compiled if target and c.search(target)]
        assert (r["rule_priority"], r["rule"], r["action"]) == ((max(fits)[0], *max(fits)[2:]) if fits else (None, None, "allow"))
    filed, loose = url_filter.index(rules, url_filter.token_counts(df, "url", set().union(*[x.tokens for x in rules])))
    under = Counter(f["token"] for f in filed)
    tried = [sum(under[t] for t in set(re.split("[^a-z0-9]+", "".join(url_parts(u)).lower()))) for u in urls]
    assert len(loose) == 1 and sum(tried) / len(tried) < 0.01 * len(rules)


def strip(t):
    return re.sub("[\x20\x09-\x0d]", "", t or "")


def dedup_rows():
    rnd = random.Random(4)
    base = ["".join(rnd.choice("ab é\n") for _ in range(rnd.choice([0, 1, 5, 200]))) for _ in range(40)]
    rows = [(k, rnd.choice(base)) for k in range(300)] + [(300 + k, t.replace(" ", "  ")) for k, t in enumerate(base)] + [(400, None), (401, ""), (402, " \t"), (403, "a\u00a0b"), (404, "ab")]
    return rows + [rows[5], rows[5], (None, base[3]), ("a" * 70 + "x") and (500, "a" * 70 + "x"), (501, "a" * 70 + "y")]


def test_exact_groups_equal_brute_force(spark):
    rows = dedup_rows()
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id bigint, text string, length string")
    done = exact_dedup.exact_groups(df, digest="text_sha256")
    got = done.collect()
    groups = {}
    for d, t in rows:
        groups.setdefault(strip(t), []).append((-len(t or ""), d is None, d or 0))
    assert len(got) == len(rows)
    kept = Counter()
    for r in got:
        text = next(k for k in groups if hashlib.sha256(k.encode()).hexdigest() == r["text_sha256"])
        best = min(groups[text])
        assert r["keep_id"] == best[2] and r["group_size"] == len(groups[text])
        kept[text] += r["kept"]
        if r["kept"]:
            assert r["doc_id"] == r["keep_id"]
    assert kept == dict.fromkeys(groups, 1)
    plain = exact_dedup.exact_groups(df)
    assert sorted(map(repr, plain.select("doc_id", "keep_id", "group_size", "kept").collect())) == sorted(map(repr, done.select("doc_id", "keep_id", "group_size", "kept").collect()))
    for x in (done, plain):
        no_python(x)
    assert exact_dedup.exact_groups(df.where("false")).count() == 0


def test_drop_copies(spark):
    rows = dedup_rows()
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id bigint, text string, length string")
    done = exact_dedup.drop_copies(df)
    no_python(done)
    assert done.columns == df.columns
    best = {}
    for d, t in rows:
        x = (-len(t or ""), d is None, d or 0, t or "")
        best[strip(t)] = min(best.get(strip(t), x), x)
    assert sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in done.collect()) == sorted((x[2], -x[0]) for x in best.values())


def test_bitmap_misses_nothing(spark):
    keys = spark.range(5000).select(F.col("id").alias("k"))
    seen = repeats.mark(spark.range(20000), [F.col("id")], repeats.bitmap(keys, 5000))
    assert seen.where("id < 5000 and not __hit").count() == 0
    assert seen.where("id >= 5000 and __hit").count() < 200
    small = repeats.mark(spark.range(20000).withColumn("__place", F.lit("kept")), [F.col("id")], repeats.bitmap(keys.where("false"), 0), "found")
    assert small.columns == ["id", "__place", "found"] and small.where("found or __place != 'kept'").count() == 0
    assert repeats.bitmap(keys, 10**12).bits == repeats.MOST


@pytest.mark.parametrize("weights", [[1], [1, 1], [5, 3, 2], [7, 1, 1], [6, 3, 3, 2, 2, 1, 1], [97, 2, 1], [1] * 30])
def test_period_deviates_by_less_than_a_block(weights):
    slots, total = mixing.period(weights), sum(weights)
    owner = {t: i for i, own in enumerate(slots) for t in own}
    assert sorted(owner) == list(range(total)) and [len(s) for s in slots] == weights
    done = [0] * len(weights)
    for t in range(total):
        done[owner[t]] += 1
        assert all(abs(done[i] - Fraction((t + 1) * w, total)) < 1 for i, w in enumerate(weights))
    for i, w in enumerate(weights):
        for j, t in enumerate(slots[i]):
            assert j * total // w <= t < -(-(j + 1) * total // w)


def simulate(blocks, weights):
    """Earliest deadline first, slot by slot."""
    left, out, start = dict(blocks), [], 0
    while any(left.values()):
        active = sorted(k for k in left if left[k])
        total, done, t = sum(weights[k] for k in active), dict.fromkeys(active, 0), 0
        while all(left[k] for k in active):
            ready = [(-(-(done[k] + 1) * total // weights[k]), k) for k in active if done[k] * total // weights[k] <= t]
            _, k = min(ready)
            out.append(k)
            done[k] += 1
            left[k] -= 1
            t += 1
        start += t
    return out


@pytest.mark.parametrize("block", [1, 4])
def test_mix_equals_simulation(spark, block):
    rnd = random.Random(block)
    rows = [(k, rnd.choice(["a", "a", "a", "b", "c", None])) for k in range(200)]
    rows += [rows[0], rows[0], (None, "b")]
    df = spark.createDataFrame([(d, s, *["clash"] * 5) for d, s in rows], "doc_id bigint, source string, slot string, key string, start string, weight string, n string")
    done, slots = mixing.mix(df, {"a": 2, "b": 3, None: 2}, block_docs=block)
    no_python(done)
    got = done.collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter(rows)
    assert len({(r["slot"], r["place"]) for r in got}) == len(rows)
    counts = Counter(s for _, s in rows)
    key = lambda s: "null" if s is None else f"={s}"
    want = simulate({key(s): -(-n // block) for s, n in counts.items()}, {"=a": 2, "=b": 3, "null": 2, "=c": 1})
    owner = {r["slot"]: key(r["source"]) for r in got}
    assert [owner[k] for k in range(slots)] == want and slots == len(want)
    assert all(r["released"] <= r["slot"] < r["due"] for r in got)
    order = mixing.in_mixed_order(df, {"a": 2, "b": 3, None: 2}, 3, block_docs=block)
    assert order.columns == df.columns and order.count() == len(rows)
    runs = order.select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("n")).orderBy("n").collect()
    slot = {(r["doc_id"], r["source"]): r["slot"] for r in got if r["doc_id"] not in (None, rows[0][0])}
    placed = [slot[r["doc_id"], r["source"]] for r in runs if (r["doc_id"], r["source"]) in slot]
    assert placed == sorted(placed)


def test_mix_bounds(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id bigint, source string")
    with pytest.raises(ValueError, match="whole numbers"):
        mixing.mix(df, {"a": 0})
    assert mixing.mix(df.where("false"), {})[0].count() == 0


@pytest.mark.parametrize("weights", [{"a": 19_999, "b": 2}, {"a": 1_000_003, "b": 700_001, "c": 13}, {f"s{k}": 1 + k % 7 for k in range(60)}])
def test_any_weights_and_sources(spark, weights, monkeypatch):
    """Long periods and many phases, through a plan in several parts too."""
    rnd = random.Random(1)
    rows = [(k, rnd.choice([*weights, "other"])) for k in range(1500)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string")
    counts = Counter(s for _, s in rows)
    want = simulate({f"={s}": -(-n // 4) for s, n in counts.items()}, {f"={s}": w for s, w in weights.items()} | {"=other": 1})
    for inline in (mixing.INLINE, 100):
        monkeypatch.setattr(mixing, "INLINE", inline)
        done, slots = mixing.mix(df, weights, block_docs=4)
        no_python(done)
        got = done.collect()
        owner = {r["slot"]: f"={r['source']}" for r in got}
        assert len(got) == len(rows) and [owner[k] for k in range(slots)] == want
        assert all(r["released"] <= r["slot"] < r["due"] for r in got)


def test_own_names_give_way(spark):
    """Columns that are called as the operators' own were stay as they are."""
    names = ["__normal", "__hit", "__full", "__rank", "__best", "__target", "__tokens", "__key", "__hash", "__bucket", "__place", "__row", "__bits", "__content"]
    df = spark.createDataFrame([(1, "a b", "s", "http://x.com/en/1", *names), (2, "ab", "s", None, *names), (3, "c", None, "u", *names)], "doc_id bigint, text string, source string, url string, " + ", ".join(f"`{n}` string" for n in names))
    for done, n in ((exact_dedup.drop_copies(df), 2), (mixing.mix(df, {"s": 2})[0], 3), (url_filter.judge(df, [url_filter.Rule("||com/en/", "block")]), 3), (simhash.drop_similar(df), 3)):
        got = done.collect()
        assert len(got) == n and all(r[c] == c for r in got for c in names)
    ids = exact_dedup.exact_groups(df.withColumn("doc_id", F.col("doc_id").cast("string")))
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in ids.collect()) == [("1", "1", True), ("2", "1", False), ("3", "3", True)]


def test_mixing_query_places_each_document_once(spark):
    got = queries.op6_mix_sources(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in docs)
    assert len({(r["slot"], r["place"]) for r in got}) == len(got)
