"""Approximate nearest neighbours by score-aware anisotropic quantisation.

Vectors are scaled to length one, so the cosine is their inner product. Product codes of four bits for each pair of
dimensions are chosen, and their codewords fitted, to penalise the part of the residual that is parallel to the vector
more than the rest, as it is the one that changes high inner products. What is coded is the difference from the centre of
the vector's list. A query's tables of inner products with the codewords are read by the codes, two at a time; of the best
of all, the original vectors are fetched and scored exactly.

Vectors are dealt out to lists by their nearest centre, about LIST of them to each, and a query scans the lists whose
centres are nearest to it. Where vectors form clusters these are few, whatever the number of lists; where they form none,
it is a good part of them, and without `recall` it is all of them, with exact scores in place of codes. Queries and codes
meet in pairs of blocks of fixed size, and only codes and hashes are copied for that.

How far codes and lists go is measured on the table itself: for ASKED of its queries the nearest of all its vectors are
found by exact scores, and it is counted in which lists they are and how many codes look better than theirs. Lists are
scanned until they hold the share `recall` of them. If too many codes look better than too many of them, vectors are coded
more finely (codes of what the codes leave), and where no codes tell them apart, the lists hold the vectors themselves.

Equal vectors are coded once, with their smallest ids, so copies cost nothing; equal codes and scores come out by id.

Defined results: vectors that are null, zero, hold a null or non-finite component, or have another length than most,
take no part; rows of the same id and vector count once; a query's own id is no candidate. A null id takes no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.llm.common import cut

#: Codewords of a pair of dimensions (four bits), and vectors in the sample that they and the centres are fitted on, about.
WORDS, SAMPLE = 16, 20_000

#: Vectors of a list, about, and lists at most; vectors and queries of a block.
LIST, LISTS, VECTORS, QUERIES = 4096, 1024, 8192, 1024

#: Vectors that are scored exactly for each query, and the share of the neighbours found in the lists that must be among them.
AGAIN, AMONG = 256, 0.99

#: Codes of a vector, each of what those before leave, in the order in which they are tried; vectors that finer ones are fitted on.
LEVELS, FINER = (1, 3), 8000

#: Queries that are measured against all vectors.
ASKED = 256


@dataclass
class Codebook:
    words: np.ndarray  # pairs of dimensions by codewords by 2
    weight: float  # of the parallel part of the residual, against 1 for the rest

    def codes(self, x: np.ndarray, sweeps: int = 2, left: np.ndarray | None = None) -> np.ndarray:
        """x: vectors of length one, padded to whole pairs; left: what of them is to be coded, all if not given. The
        nearest codewords, then each in turn given the rest."""
        pairs = len(self.words)
        parts = x.reshape(len(x), pairs, 2)
        coded = parts if left is None else left.reshape(parts.shape)
        codes = np.empty((len(x), pairs), np.int64)
        apart = np.zeros(len(x))  # parallel part of the residual
        gaps = []
        for m in range(pairs):
            gap = coded[:, m, None] - self.words[m]
            plain, along = (gap**2).sum(2), np.einsum("nkd,nd->nk", gap, parts[:, m])
            codes[:, m] = plain.argmin(1)
            apart += along[np.arange(len(x)), codes[:, m]]
            gaps.append((plain.astype(np.float32), along.astype(np.float32)))
        rows = np.arange(len(x))
        for _ in range(sweeps):
            for m, (plain, along) in enumerate(gaps):
                rest = apart - along[rows, codes[:, m]]
                codes[:, m] = (plain + (self.weight - 1) * (rest[:, None] + along) ** 2).argmin(1)
                apart = rest + along[rows, codes[:, m]]
        return codes

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return self.words[np.arange(len(self.words)), codes].reshape(len(codes), -1)


def padded(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, x.shape[1] % 2)))


def fit(x: np.ndarray, threshold: float = 0.2, rounds: int = 6, seed: int = 44, left: np.ndarray | None = None) -> Codebook:
    """x: vectors of length one. threshold: inner products above it are those that matter. left: what of them is to be
    coded, padded to whole pairs; all if not given."""
    rng, x = np.random.default_rng(seed), padded(x)
    d = x.shape[1]
    pairs = d // 2
    weight = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    parts = x.reshape(len(x), pairs, 2)
    coded = parts if left is None else left.reshape(parts.shape)
    book = Codebook(coded[rng.integers(0, len(x), WORDS)].transpose(1, 0, 2).copy(), weight)
    for k in range(rounds):
        codes = book.codes(x, 0 if k == 0 else 1, left)
        near = np.stack([book.words[m][codes[:, m]] for m in range(pairs)], 1)
        along = ((coded - near) * parts).sum(2)
        apart = along.sum(1)
        for m in range(pairs):
            p, c, rest = parts[:, m], coded[:, m], apart - along[:, m]
            outer = np.eye(2) + (weight - 1) * p[:, :, None] * p[:, None, :]
            right = c + (weight - 1) * p * (rest + (c * p).sum(1))[:, None]
            for w in range(WORDS):
                own = codes[:, m] == w
                if own.any():
                    book.words[m, w] = np.linalg.solve(outer[own].sum(0), right[own].sum(0))
    return book


def packed(codes: np.ndarray) -> np.ndarray:
    """Two codes in a byte."""
    codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2))).astype(np.uint8)
    return codes[:, 0::2] | codes[:, 1::2] << 4


def unpacked(data: np.ndarray, pairs: int) -> np.ndarray:
    return np.stack([data & 15, data >> 4], 2).reshape(len(data), -1)[:, :pairs]


def tables(queries: np.ndarray, book: Codebook) -> np.ndarray:
    """For each query and byte of a code, the inner product that each of its 256 values stands for."""
    q = padded(queries).reshape(len(queries), -1, 2)
    single = np.einsum("qmd,mkd->qmk", q, book.words)
    single = np.pad(single, ((0, 0), (0, single.shape[1] % 2), (0, 0)))
    low, high = single[:, 0::2], single[:, 1::2]
    return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(queries), low.shape[1], 256).astype(np.float32)


def centres(x: np.ndarray, n: int, rounds: int = 8, seed: int = 45) -> np.ndarray:
    """n directions that the vectors of length one gather about."""
    out = x[np.random.default_rng(seed).choice(len(x), min(n, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = (x @ out.T).argmax(1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        out = np.where(size > 0, sums / np.maximum(size, 1e-300), out)
    return out


def probes(x: np.ndarray, middle: np.ndarray, k: int, recall: float, asked: int = 400) -> int:
    """How many nearest lists hold this share of the k nearest others of some of the sample's vectors. In a sample
    neighbours are farther than in all, so it is no less there."""
    asked = min(asked, len(x))
    near = x[:asked] @ x.T
    near[np.arange(asked), np.arange(asked)] = -np.inf
    best = np.argpartition(-near, min(k, len(x) - 1) - 1, axis=1)[:, :k] if len(x) > k else np.argsort(-near, axis=1)[:, : len(x) - 1]
    place = np.argsort(np.argsort(-(x[:asked] @ middle.T), axis=1), axis=1)
    found = np.take_along_axis(place, (x @ middle.T).argmax(1)[best], axis=1).ravel()
    share = np.cumsum(np.bincount(found, minlength=len(middle))) / max(1, len(found))
    return int(np.searchsorted(share, min(recall, share[-1]) - 1e-12)) + 1 if len(found) else len(middle)


def valid(vector: str) -> Column:
    """Finite, and not zero."""
    v = F.col(f"`{vector}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each two rows, in double precision; very large and very small components are scaled first, so no square is lost."""
    x, y = (v if 1e-150 < np.abs(v).max() < 1e150 and (np.abs(v).max(1) > 1e-100).all() else v / np.abs(v).max(1, keepdims=True) for v in (x, y))
    return np.einsum("nd,nd->n", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length without nulls as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _unit(rows: list | np.ndarray) -> np.ndarray:
    x = np.asarray(rows, float)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class Index:
    books: list[Codebook]  # each codes what those before leave of the difference from the centre
    middle: np.ndarray  # centres of the lists
    probed: int  # lists that a query scans

    def lists(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.middle.T).argmax(1)

    def near(self, x: np.ndarray) -> np.ndarray:
        """All lists, the nearest first."""
        return np.argsort(-(x @ self.middle.T), axis=1, kind="stable")

    def codes(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        left, out = padded(x - self.middle[own]), []
        for book in self.books:
            codes = book.codes(padded(x), left=left)
            left = left - book.decoded(codes)
            out.append(packed(codes))
        return np.concatenate(out, 1)

    def decoded(self, codes: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Vectors, padded, that packed codes stand for."""
        return padded(self.middle[own]) + sum(book.decoded(unpacked(c, len(book.words))) for book, c in zip(self.books, np.split(codes, len(self.books), axis=1), strict=True))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        return np.concatenate([tables(queries, book) for book in self.books], 1)


def fit_index(x: np.ndarray, total: int, k: int, recall: float | None) -> Index:
    """x: a sample of vectors of length one of a table that has total of them."""
    middle = centres(x, max(1, min(LISTS, total // LIST, len(x) // 8)))
    index = Index([], middle, len(middle) if recall is None else probes(x, middle, k, recall))
    index.books.append(fit(x, left=padded(x - middle[index.lists(x)])))
    return index


def refined(index: Index, x: np.ndarray, levels: int) -> Index:
    """The index with as many codes of a vector."""
    x, books = x[:FINER], list(index.books)
    own = index.lists(x)
    while len(books) < levels:
        now = Index(books, index.middle, index.probed)
        books.append(fit(x, rounds=4, left=padded(x) - now.decoded(now.codes(x, own), own)))
    return Index(books, index.middle, index.probed)


@dataclass
class Truth:
    """The k nearest other vectors of some queries, by exact scores of all."""

    queries: np.ndarray  # of length one
    names: np.ndarray  # their hashes
    asks: np.ndarray  # for each neighbour, the place of its query
    found: np.ndarray  # the neighbours, of length one

    def lists(self, index: Index, recall: float) -> int:
        """How many nearest lists hold this share of the neighbours."""
        place = np.argsort(index.near(self.queries), axis=1)[self.asks, index.lists(self.found)]
        return int(np.sort(place)[max(0, int(np.ceil(recall * len(place))) - 1)]) + 1

    def ranks(self, index: Index, coded: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """How many codes of the scanned lists, and of its own list, look as good as each neighbour's in these lists or better."""
        scanned = np.zeros((len(self.queries), len(index.middle)), bool)
        np.put_along_axis(scanned, index.near(self.queries)[:, : index.probed], True, axis=1)
        own = index.lists(self.found)
        inside = scanned[self.asks, own]
        asks, own, found, q = self.asks[inside], own[inside], self.found[inside], padded(self.queries)
        least = (index.decoded(index.codes(found, own), own) * q[asks]).sum(1) - 1e-12
        shared = coded.sparkSession.sparkContext.broadcast((index, q, self.names, scanned, asks, own, least))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, q, names, scanned, asks, own, least = shared.value
            both, alone = np.zeros(len(least), np.int64), np.zeros(len(least), np.int64)
            for b in batches:
                if b.num_rows:
                    h, lists = b.column(0).to_numpy(), b.column(1).to_numpy()
                    codes = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(len(h), -1)
                    guess = q @ index.decoded(codes, lists).T
                    guess[~scanned[:, lists] | (names[:, None] == h)] = -np.inf
                    for t in range(len(least)):
                        better = np.flatnonzero(guess[asks[t]] >= least[t])
                        both[t] += len(better)
                        alone[t] += (lists[better] == own[t]).sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(least))), pa.array(both), pa.array(alone)], names=["t", "both", "alone"])

        counted = coded.select("h", "list", "code").mapInArrow(count, "t bigint, both bigint, alone bigint").groupBy("t").agg(F.sum("both").alias("both"), F.sum("alone").alias("alone"))
        rows = counted.collect()
        return np.array([r["both"] for r in rows], np.int64), np.array([r["alone"] for r in rows], np.int64)


def truth(distinct: DataFrame, query: DataFrame, k: int) -> Truth | None:
    """distinct: vectors v with their hashes h; query: those, v and qh, that ask. None where nothing is asked or found."""
    drawn = query.select("qh", "v").orderBy(F.xxhash64("qh")).limit(max(1, min(ASKED, 8 * ASKED // k))).collect()
    if not drawn:
        return None
    shared = distinct.sparkSession.sparkContext.broadcast((_unit([r["v"] for r in drawn]), np.array([r["qh"] for r in drawn], np.int64)))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, names = shared.value
        score, found = np.zeros((len(q), 0)), np.zeros((len(q), 0, q.shape[1]))
        for b in batches:
            if b.num_rows:
                x = _unit(_matrix(b.column(0)))
                made = q @ x.T
                made[names[:, None] == b.column(1).to_numpy()] = -np.inf
                top = np.argpartition(-made, k - 1, axis=1)[:, :k] if len(x) > k else np.tile(np.arange(len(x)), (len(q), 1))
                score, found = np.concatenate([score, np.take_along_axis(made, top, 1)], 1), np.concatenate([found, x[top]], 1)
                top = np.argsort(-score, axis=1)[:, :k]
                score, found = np.take_along_axis(score, top, 1), np.take_along_axis(found, top[:, :, None], 1)
        a, c = np.nonzero(np.isfinite(score))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(score[a, c]), pa.array([x.tobytes() for x in found[a, c]], pa.binary())], names=["a", "score", "x"])

    made = distinct.select("v", "h").mapInArrow(best, "a bigint, score double, x binary")
    rows = made.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "x"))).where(F.col("r") <= k).select("a", "x").collect()
    if not rows:
        return None
    return Truth(*shared.value, np.array([r["a"] for r in rows]), np.stack([np.frombuffer(r["x"]) for r in rows]))


def nearest(df: DataFrame, is_query: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding", recall: float | None = 0.985) -> DataFrame:
    """(query_id, rank, id, score): of each row where is_query holds the k nearest others by cosine. recall: the share of
    the measured queries' neighbours that the scanned lists are to hold; None: exactly the nearest, by scores of every vector
    for every query."""
    spark = df.sparkSession
    rows = df.where(valid(vector) & F.col(f"`{id}`").isNotNull()).select(F.col(f"`{id}`").alias("id"), F.col(f"`{vector}`").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return rows.where("false").select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias(id), F.lit(0.0).alias("score"))
    d, total = sizes[0]["d"], sizes[0]["n"]
    rows = rows.where(F.size("v") == d)
    ranked = rows.select("id", "v").withColumn("r", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    distinct = cut(ranked.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("h", F.xxhash64("v")))
    share = min(1.0, SAMPLE / total)
    drawn = distinct.where(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("v").limit(2 * SAMPLE).collect()
    if not drawn:
        drawn = distinct.select("v").limit(SAMPLE).collect()
    sample = _unit([r["v"] for r in drawn])
    index = fit_index(sample, total, k, recall)
    query = cut(rows.where("asks").select("id", "v").distinct().withColumn("qh", F.xxhash64("v")))
    asked = query.select("qh", "v").dropDuplicates(["qh"])
    kind = df.schema[id].dataType.simpleString()

    def coded_by(index: Index | None, lists: Index) -> DataFrame:
        shared = spark.sparkContext.broadcast((index, lists))

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, lists = shared.value
            for b in batches:
                if b.num_rows:
                    v = _matrix(b.column(0))
                    x = _unit(v)
                    own = lists.lists(x)
                    made = v if index is None else index.codes(x, own)
                    yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in made], pa.binary())], names=["h", "id", "list", "code"])

        return cut(distinct.select("v", "h", F.col("ids")[0].alias("id")).mapInArrow(code, f"h bigint, id {kind}, list int, code binary"))

    known = None if recall is None else truth(distinct, asked, k)
    coded, from_block = None, k + 1
    if known is not None:
        index.probed = max(index.probed, known.lists(index, recall))
        for levels in LEVELS:
            index = refined(index, sample, levels)
            coded = coded_by(index, index)
            both, alone = known.ranks(index, coded)
            if (both <= AGAIN).mean() >= AMONG:
                from_block = min(AGAIN, max(2 * k, int(1.25 * np.quantile(alone, (1 + AMONG) / 2)) + 1))
                break
            coded = None
    whole = coded is None  # vectors stand in place of codes
    if whole:
        coded = coded_by(None, index)
    shared = spark.sparkContext.broadcast(index)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column(1))
                near = shared.value.near(_unit(v))[:, : shared.value.probed]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([q.tobytes() for q in v], pa.binary()), pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["qh", "q", "lists"])

    seen = cut(asked.mapInArrow(probe, "qh bigint, q binary, lists array<int>"))
    parts = lambda rows, size, name: rows.groupBy("list").agg(F.expr(f"cast((count(*) + {size - 1}) div {size} as int)").alias(name))
    # no more rows than lists
    lists = F.broadcast(parts(coded, VECTORS, "blocks").join(parts(seen.select(F.explode("lists").alias("list")), QUERIES, "asks"), "list"))
    seen = seen.select("qh", "q", F.explode("lists").alias("list")).join(lists, "list")
    seen = seen.select("list", F.pmod(F.xxhash64("qh"), F.col("asks")).cast("int").alias("ask"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "qh", "q")
    held = coded.join(lists, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("ask"), F.pmod("h", F.col("blocks")).cast("int").alias("block"), "h", "id", "code")

    def scan(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        held = held.sort_by("id")
        if asked.num_rows and held.num_rows:
            names = asked.column("qh").to_numpy()
            data = b"".join(held.column("code").to_pylist())
            v = np.frombuffer(b"".join(asked.column("q").to_pylist())).reshape(len(names), -1)
            q, own = _unit(v), shared.value.middle[asked.column("list")[0].as_py()]
            if whole:
                x = np.frombuffer(data).reshape(held.num_rows, -1)
                unit = _unit(x)
            else:
                x = np.frombuffer(data, np.uint8).reshape(held.num_rows, -1).T.copy()
            for i in range(0, len(names), 64):
                made = q[i : i + 64] @ unit.T if whole else shared.value.tables(q[i : i + 64])
                for j, t in enumerate(made, i):
                    if whole:  # those that rounding may have put below the last come along, and exact scores decide
                        again = np.flatnonzero(t >= -np.partition(-t, from_block - 1)[from_block - 1] - 1e-13) if len(t) > from_block else np.arange(len(t))
                        guess = cosines(np.broadcast_to(v[j], (len(again), len(v[j]))), x[again])
                        first = np.argsort(-guess, kind="stable")[:from_block]
                        again, guess = again[first], guess[first]
                    else:
                        guess = t[0].take(x[0])
                        for m in range(1, len(x)):
                            guess += t[m].take(x[m])
                        again = np.arange(len(guess))
                        if len(guess) > from_block:
                            last = -np.partition(-guess, from_block - 1)[from_block - 1]
                            above = np.flatnonzero(guess > last)
                            again = np.concatenate([above, np.flatnonzero(guess == last)[: from_block - len(above)]])
                        guess = guess[again] + q[j] @ own
                    out.append((np.full(len(again), names[j]), again, guess))
        name, again, guess = [np.concatenate([o[k] for o in out]) for k in range(3)] if out else [np.zeros(0, t) for t in (np.int64, np.int64, float)]
        picked = held.select(["h", "id"]).take(pa.array(again))
        return pa.table([pa.array(name), picked.column("h"), picked.column("id"), pa.array(guess.astype(float))], names=["qh", "h", "id", "guess"])

    met = seen.groupBy("list", "ask", "block").cogroup(held.groupBy("list", "ask", "block")).applyInArrow(scan, f"qh bigint, h bigint, id {kind}, guess double")
    order = Window.partitionBy("qh").orderBy(F.desc("guess"), "id", "h")
    best = met.withColumn("r", F.row_number().over(order)).where(F.col("r") <= max(AGAIN, k + 1)).select("qh", "h")
    pairs = best.join(distinct, "h").join(query.select("qh", F.col("id").alias("query_id"), F.col("v").alias("q")), "qh").select("query_id", "qh", "q", "v", "ids")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                made = cosines(_matrix(b.column(2)), _matrix(b.column(3)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made), b.column(4)], names=["query_id", "qh", "score", "ids"])

    scored = pairs.mapInArrow(score, f"query_id {kind}, qh bigint, score double, ids array<{kind}>")
    found = scored.select("query_id", "qh", "score", F.explode("ids").alias(id)).where(F.col(f"`{id}`") != F.col("query_id"))
    place = Window.partitionBy("query_id", "qh").orderBy(F.desc("score"), F.col(f"`{id}`"))
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", F.col(f"`{id}`"), "score")
