"""Connected components, and cosine neighbours in blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociframe.checkpoint import cut


#: Edges that a round keeps in one file, about.
PART = 50_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(u, v): each node that has an edge, but for the smallest of its component, and that smallest node, by alternating
    large-star and small-star rounds. Loops and edges with a null end count for nothing. Each round is kept in the shared
    folder; the rounds end when one changes nothing."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("whole"))
    e = cut(e.where("whole and u != v").select("u", "v").distinct())
    state = _state(e)
    while True:
        n = max(1, -(-state[0] // PART))  # few edges need few files
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(n))  # on its own, so that a hub's join can be split
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(first, "u").where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        e = cut(small.unionByName(first.select("u", F.col("m").alias("v"))).distinct().coalesce(n))
        if (now := _state(e)) == state:
            return e
        state = now


def labelled(nodes: DataFrame, edges: DataFrame, node: str = "node", a: str = "a", b: str = "b") -> DataFrame:
    """nodes with component: the smallest node that each reaches."""
    found = components(edges, a, b).select(F.col("u").alias(node), F.col("v").alias("component"))
    return nodes.join(found, node, "left").withColumn("component", F.coalesce("component", node))


def communities(edges: DataFrame, resolution: float = 1.0, rounds: int = 12, levels: int = 6, a: str = "a", b: str = "b", weight: str = "w", seed: int = 44) -> DataFrame:
    """(node, community): groups of nodes that are joined more than their weights would have it, by moves that raise the
    modularity: in each round half of the nodes (by hash) go where they gain most, all at once; when none gains, or after
    so many rounds, each group becomes a node and the moves begin anew. A community is named by its smallest node. Each
    round is a few joins by node and by community, kept in the shared folder."""
    half = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"), F.col(weight).cast("double").alias("w"))
    e = cut(half.unionByName(half.where("u != v").select(F.col("v").alias("u"), F.col("u").alias("v"), "w")).groupBy("u", "v").agg(F.sum("w").alias("w")))
    total = e.agg(F.sum("w")).first()[0] or 1.0
    named = cut(e.select(F.col("u").alias("node"), F.col("u").alias("community")).distinct())
    for level in range(levels):
        degrees = cut(e.groupBy("u").agg(F.sum("w").alias("k")))
        now, still = cut(degrees.select("u", "k", F.col("u").alias("c"))), 0
        for round_ in range(rounds):
            sums = now.groupBy("c").agg(F.sum("k").alias("s"))
            to = e.where("u != v").join(now.select(F.col("u").alias("v"), "c"), "v").groupBy("u", "c").agg(F.sum("w").alias("w"))
            own = now.select("u", "c", F.lit(0.0).alias("w"))
            tried = to.unionByName(own).groupBy("u", "c").agg(F.sum("w").alias("w")).join(now.select("u", "k", F.col("c").alias("mine")), "u").join(sums, "c")
            gain = F.col("w") - resolution * F.col("k") * (F.col("s") - F.when(F.col("c") == F.col("mine"), F.col("k")).otherwise(0.0)) / total
            best = tried.withColumn("g", F.round(gain, 12)).groupBy("u", "k", "mine").agg(F.min_by("c", F.struct(-F.col("g"), F.col("c") != F.col("mine"), "c")).alias("best"))
            turn = F.pmod(F.xxhash64("u", F.lit(seed + level)) + round_, F.lit(2)) == 0
            following = cut(best.select("u", "k", F.when(turn, F.col("best")).otherwise(F.col("mine")).alias("c"), (turn & (F.col("best") != F.col("mine"))).alias("moved")))
            moved = following.where("moved").limit(1).count()
            now, still = following.drop("moved"), 0 if moved else still + 1
            if still == 2:  # neither half gains
                break
        least = now.groupBy("c").agg(F.min("u").alias("least"))
        named_groups = cut(now.join(least, "c").select("u", "least"))
        grown = e.join(named_groups.select("u", F.col("least").alias("x")), "u").join(named_groups.select(F.col("u").alias("v"), F.col("least").alias("y")), "v")
        named = cut(named.join(named_groups.select(F.col("u").alias("community"), "least"), "community").select("node", F.col("least").alias("community")))
        before, e = degrees.count(), cut(grown.groupBy(F.col("x").alias("u"), F.col("y").alias("v")).agg(F.sum("w").alias("w")))
        if named_groups.select("least").distinct().count() == before:
            break
    return named


def _block_pairs(df: DataFrame, id: str, vector: str, block: int, keep) -> DataFrame:
    """(a, b, cosine): rows meet in pairs of blocks of bounded size, each compared by one matrix product; keep(cosines, ids
    of the rows, ids of the columns) gives the cells to return."""
    import numpy as np
    import pyarrow as pa

    n = df.count()
    blocks = max(1, -(-n // block))
    rows = df.where(F.col(vector).isNotNull()).select(F.col(id).cast("bigint").alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(id), F.lit(blocks)).cast("int").alias("own"))
    left = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = rows.select(F.col("id").alias("id2"), F.col("v").alias("v2"), F.col("own").alias("other"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("own"))

    def scan(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        p, q = np.array(x.column("v").to_pylist(), float), np.array(y.column("v2").to_pylist(), float)
        norms = [np.linalg.norm(m, axis=1) for m in (p, q)]
        with np.errstate(invalid="ignore", divide="ignore"):
            c = p @ q.T / np.outer(*norms)
        i, j = x.column("id").to_numpy(), y.column("id2").to_numpy()
        k, m = keep(c, i, j)
        return pa.table({"a": i[k], "b": j[m], "cosine": c[k, m]})

    return left.groupBy("own", "other").cogroup(right.groupBy("own", "other")).applyInArrow(scan, "a bigint, b bigint, cosine double")


def cosine_pairs(df: DataFrame, id: str, vector: str, above: float, block: int = 2048) -> DataFrame:
    """(a, b, cosine) of every two different rows whose cosine is above the threshold, both ways round."""

    def keep(c, i, j):
        return ((c > above) & (i[:, None] != j[None, :])).nonzero()

    return _block_pairs(df, id, vector, block, keep)


def nearest(df: DataFrame, id: str, vector: str, k: int, block: int = 2048) -> DataFrame:
    """(a, b, rank, cosine): the k nearest others of each row, ties (to 12 decimals) by id. Each pair of blocks gives k
    for a row at most."""

    def keep(c, i, j):
        import numpy as np

        near = np.where((i[:, None] != j[None, :]) & ~np.isnan(c), np.round(c, 12), -3.0)
        order = np.argsort(j, kind="stable")
        top = order[np.argsort(-near[:, order], axis=1, kind="stable")[:, :k]]
        rows = np.repeat(np.arange(len(i)), top.shape[1])
        held = near[rows, top.ravel()] > -2
        return rows[held], top.ravel()[held]

    w = Window.partitionBy("a").orderBy(F.desc(F.round("cosine", 12)), "b")
    return _block_pairs(df, id, vector, block, keep).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
