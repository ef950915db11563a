"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Each source's documents form blocks. Block j (from 1) of a source with the share s of all weights is released at slot
floor((j - 1) / s) and due at slot ceil(j / s); of the released blocks, the one due first takes the next slot. As whole
numbers are the weights, the schedule repeats with their sum, so one period is planned, or as much of it as there are
blocks, and every document finds its slot by arithmetic. When a source has no more blocks, the rest share its slots by
their own weights in a new phase. Within a phase every source is, at every slot, less than one block from its share.

The driver plans each phase in steps of its period: a number of four bytes for each slot of a period, a row for each source
and phase. A plan of over INLINE numbers travels as a table in the shared folder, of any size.

Defined results: every row gets one place; null is a source of its own; sources without a weight take the default. The
order within a source is by a hash of the id, then by id; fully equal rows take neighbouring places in either order.
"""

from __future__ import annotations

import bisect
import heapq
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociframe.llm.common import literal_table, own_prefix

#: Numbers of a plan that travel with the query, and that one part of a larger one has.
INLINE = 20_000


def period(weights: list[int], most: int | None = None) -> list[list[int]]:
    """The slots of each source's blocks within one period, or its first slots: earliest deadline first among released
    blocks."""
    total = sum(weights)
    slots: list[list[int]] = [[] for _ in weights]
    waiting = [(0, i) for i in range(len(weights))]
    ready: list[tuple[int, int]] = []
    for t in range(total if most is None else min(total, most)):
        while waiting and waiting[0][0] <= t:
            _, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[i]) + 1) * total // weights[i]), i))
        _, i = heapq.heappop(ready)
        slots[i].append(t)
        if len(slots[i]) < weights[i]:
            heapq.heappush(waiting, (len(slots[i]) * total // weights[i], i))
    return slots


def phases(blocks: dict[str, int], weights: dict[str, int]) -> list[dict]:
    """For each phase and source: its first block, the block after its last, the phase's first slot, and the period."""
    done, out, start = dict.fromkeys(blocks, 0), [], 0
    while active := [k for k in sorted(blocks) if done[k] < blocks[k]]:
        common = math.gcd(*[weights[k] for k in active])
        own = [weights[k] // common for k in active]
        total, left = sum(own), [blocks[k] - done[k] for k in active]
        slots = period(own, sum(left))
        # the slot of each source's last block, where the planned part of the period has it
        ends = [(n - 1) // w * total + s[(n - 1) % w] for n, w, s in zip(left, own, slots, strict=True) if (n - 1) % w < len(s)]
        last = min(ends)
        for k, w, s in zip(active, own, slots, strict=True):
            n = (last + 1) // total * w + bisect.bisect_left(s, (last + 1) % total)
            if n:
                out.append({"key": k, "first": done[k], "until": done[k] + n, "start": start, "total": total, "weight": w, "slots": s[: n if n < w else w]})
            done[k] += n
        start += last + 1
    return out


PHASE = "key:string,first:bigint,until:bigint,start:bigint,total:bigint,weight:bigint,at:bigint,slots:array<int>"


def _key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("null"))


def _planned(spark: SparkSession, plan: list[dict]) -> DataFrame:
    """The plan as a table; a large one goes through the shared folder, some of it at a time."""
    parts: list[list[dict]] = [[]]
    room = INLINE
    for row in plan:
        for at in range(0, len(row["slots"]), INLINE):  # a long list of slots in several rows
            piece = row["slots"][at : at + INLINE]
            if room < len(piece) + 1 and parts[-1]:
                parts.append([])
                room = INLINE
            parts[-1].append(row | {"slots": piece, "at": at})
            room -= len(piece) + 1
    table = literal_table(spark, parts, PHASE)
    return F.broadcast(table) if len(parts) == 1 else table


def mix(docs: DataFrame, weights: dict[str | None, int], id: str = "doc_id", source: str = "source", block_docs: int = 16, default: int = 1) -> tuple[DataFrame, int]:
    """docs with block (from 0), place (within the block), slot, and the slots at which the block was released and
    due; and the number of slots. The driver holds one row for each source."""
    if any(not isinstance(w, int) or w < 1 for w in [*weights.values(), default]):
        raise ValueError("weights are whole numbers from 1")
    counts = docs.groupBy(_key(source).alias("key")).agg(F.count("*").alias("n")).collect()
    named = {"null" if k is None else f"={k}": w for k, w in weights.items()}
    blocks = {r["key"]: -(-r["n"] // block_docs) for r in counts}
    plan = phases(blocks, {k: named.get(k, default) for k in blocks})
    # as many ranges of the hash as rows in each, for the largest source: neither the ranks within nor the sums over them grow faster
    buckets = 1 << math.ceil(math.log2(max([1, *(r["n"] for r in counts)])) / 2)

    new = ("block", "place", "slot", "released", "due")
    p = own_prefix(docs)
    key, hash_, bucket, rank, held = (f"{p}{x}" for x in ("key", "hash", "bucket", "rank", "held"))
    keyed = docs.drop(*new).withColumns({key: _key(source), hash_: F.md5(F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")))})
    keyed = keyed.withColumn(bucket, F.shiftright(F.conv(F.substring(hash_, 1, 8), 16, 10).cast("bigint") * buckets, 32))  # by the hash's own order
    sizes = keyed.groupBy(F.col(key).alias("key"), F.col(bucket).alias("bucket")).agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("key").orderBy("bucket")) - F.col("n"))
    # each range meets the phases that its blocks fall in, few as a rule, so that a row looks through these alone
    steps = _planned(docs.sparkSession, plan)
    span = {"low": F.expr(f"before div {block_docs}"), "high": F.expr(f"(before + n - 1) div {block_docs}")}
    own = F.struct("first", "until", "start", "total", "weight", "at", "slots")
    met = sizes.withColumns(span).join(steps, "key").where("high >= first and low < until")
    ranges = met.groupBy("key", "bucket").agg(F.any_value("before").alias("before"), F.collect_list(own).alias("phases"))
    ranges = ranges.select(F.col("key").alias(key), F.col("bucket").alias(bucket), F.struct("before", "phases").alias(held))
    ranked = keyed.withColumn(rank, F.row_number().over(Window.partitionBy(key, bucket).orderBy(hash_, F.col(f"`{id}`"))))
    ranked = ranked.join(ranges, [key, bucket]).withColumn(rank, F.col(rank) - 1 + F.col(f"{held}.before"))
    ranked = ranked.withColumns({"block": F.expr(f"{rank} div {block_docs}"), "place": (F.col(rank) % block_docs).cast("int")})

    def at(x: Column) -> Column:  # the place of the block's slot in what a row of the plan has
        return (F.col("block") - x["first"]) % x["weight"] - x["at"]

    mine = F.filter(f"{held}.phases", lambda x: (F.col("block") >= x["first"]) & (F.col("block") < x["until"]) & (at(x) >= 0) & (at(x) < F.size(x["slots"])))
    ranked = ranked.withColumn(held, F.element_at(mine, 1)).withColumn(rank, F.col("block") - F.col(f"{held}.first"))
    done = ranked.withColumns(
        {
            "slot": F.expr(f"{held}.start + ({rank} div {held}.weight) * {held}.total + element_at({held}.slots, cast({rank} % {held}.weight - {held}.at as int) + 1)"),
            "released": F.expr(f"{held}.start + ({rank} * {held}.total) div {held}.weight"),
            "due": F.expr(f"{held}.start - ((-({rank} + 1) * {held}.total) div {held}.weight) + if(({rank} + 1) * {held}.total % {held}.weight = 0, 0, 1)"),
        }
    )
    return done.drop(key, hash_, bucket, rank, held), sum(blocks.values())


def in_mixed_order(docs: DataFrame, weights: dict[str | None, int], partitions: int | None = None, **options) -> DataFrame:
    """docs, with their own columns only, dealt so that partition p holds the p-th run of slots in order; written files
    read one after another then follow the mix. Every row stays."""
    columns = docs.columns
    mixed, slots = mix(docs, weights, **options)
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = mixed.repartitionById(n, F.expr(f"cast(slot * {n} div {max(1, slots)} as int)"))
    return placed.sortWithinPartitions("slot", "place").select(*[F.col(f"`{c}`") for c in columns])
