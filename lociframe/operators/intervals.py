"""Interval algebra on half-open [start, end) rows with a key, as DataFrame transforms.

Joins never leave the key: both sides are filed under fixed-width bins of the coordinate, the equi-join on (key, bin)
spreads a hot key over its bins, and a pair counts only in the bin where the later of both starts lies, so no distinct is
needed. Sweeps (merge, rejoin, chain, runs, disjoin) take one window by key, or with spread ranges of it, for keys too large
for one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.operators.ordered import dealt, running, running_sums


def _bins(start: Column, end: Column, width: int) -> Column:
    last = F.greatest(end - 1, start)
    return F.explode(F.sequence(F.floor(start / width).cast("bigint"), F.floor(last / width).cast("bigint")))


def overlap_join(a: DataFrame, b: DataFrame, key: str = "key", a_range: tuple[str, str] = ("a_start", "a_end"), b_range: tuple[str, str] = ("b_start", "b_end"), width: int = 64, min_overlap: int = 1) -> DataFrame:
    """Every pair of rows that share the key and at least min_overlap positions, with the length they share. The two
    sides have no other column in common than the key."""
    left = a.withColumn("__bin", _bins(F.col(a_range[0]), F.col(a_range[1]), width))
    right = b.withColumn("__bin", _bins(F.col(b_range[0]), F.col(b_range[1]), width))
    start, end = F.greatest(a_range[0], b_range[0]), F.least(a_range[1], b_range[1])
    met = left.join(right, [key, "__bin"]).where((end - start >= min_overlap) & (F.floor(start / width) == F.col("__bin")))
    return met.withColumn("overlap", end - start).drop("__bin")


def clip_to(a: DataFrame, b: DataFrame, key: str = "key", a_range: tuple[str, str] = ("a_start", "a_end"), b_range: tuple[str, str] = ("b_start", "b_end"), width: int = 64) -> DataFrame:
    """One row for each overlap: a's columns, with start and end of what b leaves of it."""
    met = overlap_join(a, b, key, a_range, b_range, width)
    return met.withColumns({"start": F.greatest(a_range[0], b_range[0]), "end": F.least(a_range[1], b_range[1])})


def containment_join(windows: DataFrame, points: DataFrame, key: str = "key", start: str = "start", end: str = "end", pos: str = "pos", vision: float = 1.0, width: int = 4096) -> DataFrame:
    """Windows with the points strictly inside their central share: start + margin < pos < end - margin, where margin is
    half of what the share leaves, rounded down."""
    margin = F.floor((F.col(end) - F.col(start)) * (1 - vision) / 2).cast("bigint")
    filed = windows.withColumn("__bin", _bins(F.col(start), F.col(end), width))
    placed = points.withColumn("__bin", F.floor(F.col(pos) / width).cast("bigint"))
    return filed.join(placed, [key, "__bin"]).where((F.col(pos) > F.col(start) + margin) & (F.col(pos) < F.col(end) - margin)).drop("__bin")


def _islands(df: DataFrame, key: str, order: list[str], opens: Column, spread: bool) -> DataFrame:
    """A dealt table with __island: how many rows have opened one, up to each."""
    marked = df.withColumn("__open", opens)
    return running(marked, [key], order, {"__island": ("sum", F.col("__open"))}, spread).withColumn("__island", F.col("__island") + F.col("__open")).drop("__open", "__part")


def merge(df: DataFrame, key: str = "key", start: str = "start", end: str = "end", touching: bool = True, spread: bool = False) -> DataFrame:
    """The union of each key's intervals; touching: [0,5) and [5,9) become one. spread: a key may span any number of
    tasks, as only one row of each range of starts meets the others."""
    d = running(dealt(df, [key], start, spread), [key], [start, end], {"__reach": ("max", F.col(end))}, spread)
    opens = F.when(F.col(start) <= F.col("__reach") if touching else F.col(start) < F.col("__reach"), 0).otherwise(1)
    marked = _islands(d, key, [start, end], opens, spread)
    return marked.groupBy(key, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__island")


def subtract(spans: DataFrame, holes: DataFrame, key: str = "key", start: str = "start", end: str = "end", spread: bool = False) -> DataFrame:
    """What holes leave of each key's one span. Overlapping holes are merged first; touching and outlying ones are fine."""
    merged = merge(holes, key, start, end, spread=spread).select(F.col(key).alias("__key"), F.col(start).alias("__hs"), F.col(end).alias("__he"))
    within = (F.col(key) == F.col("__key")) & (F.col("__hs") < F.col(end)) & (F.col("__he") > F.col(start))
    inside = spans.join(merged, within, "left").select(key, start, end, "__hs", "__he")
    w = Window.partitionBy(key, start, end).orderBy("__hs")
    pieces = inside.withColumn("__next", F.coalesce(F.lead("__hs").over(w), F.col(end))).withColumn("__first", F.row_number().over(w) == 1)
    before = F.when(F.col("__first") & F.col("__hs").isNotNull(), F.struct(F.col(start).alias("s"), F.col("__hs").alias("e")))
    after = F.struct(F.coalesce("__he", F.col(start)).alias("s"), F.col("__next").alias("e"))
    return pieces.select(key, F.explode(F.array(before, after)).alias("p")).where("p is not null").select(key, F.col("p.s").alias(start), F.col("p.e").alias(end)).where(F.col(start) < F.col(end))


def tile(df: DataFrame, length: int, stride: int, start: str = "start", end: str = "end", snap: int | None = None, inclusive: bool = True) -> DataFrame:
    """Windows of this length from each interval's (snapped) start on; inclusive: the last may end where it ends."""
    first = F.col(start) if not snap else (F.ceil(F.col(start) / snap) * snap).cast("bigint")
    last = F.col(end) - length - (0 if inclusive else 1)
    at = F.when(last >= first, F.sequence(first, last, F.lit(stride).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    rest = [F.col(c) for c in df.columns if c not in (start, end)]
    return df.select(*rest, F.explode(at).alias(start)).withColumn(end, F.col(start) + length)


def rejoin(df: DataFrame, key: str = "key", start: str = "start", end: str = "end", spread: bool = False) -> DataFrame:
    """Intervals that end where the next begins become one."""
    d = running(dealt(df, [key], start, spread), [key], [start, end], {"__last": ("last", F.col(end))}, spread)
    marked = _islands(d, key, [start, end], F.when(F.col("__last") == F.col(start), 0).otherwise(1), spread)
    return marked.groupBy(key, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def break_large(df: DataFrame, most: int, start: str = "start", end: str = "end", depth: int = 40) -> DataFrame:
    """Halve intervals until none is longer than most; nothing is lost. The halving is arithmetic on the number of cuts:
    each interval knows from its length how deep it goes, and each piece descends on its own."""
    length = F.col(end) - F.col(start)
    levels = F.greatest(F.ceil(F.log2(length / F.lit(float(most)))), F.lit(0)).cast("int")
    grown = df.withColumn("__p", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.pow(F.lit(2.0), levels).cast("bigint") - 1), lambda i: F.struct(i.alias("i"), levels.alias("n")))))
    # piece i of 2^n: follow its bits from the top, stopping as soon as the part is short enough
    walk = F.aggregate(
        F.when(F.col("__p.n") > 0, F.sequence(F.col("__p.n") - 1, F.lit(0))).otherwise(F.array().cast("array<int>")),
        F.struct(F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e"), F.lit(True).alias("own")),
        lambda acc, bit: F.when(
            acc["e"] - acc["s"] > most,
            F.struct(
                F.when(F.getbit(F.col("__p.i"), bit) == 1, acc["s"] + F.floor((acc["e"] - acc["s"]) / 2).cast("bigint")).otherwise(acc["s"]).alias("s"),
                F.when(F.getbit(F.col("__p.i"), bit) == 1, acc["e"]).otherwise(acc["s"] + F.floor((acc["e"] - acc["s"]) / 2).cast("bigint")).alias("e"),
                acc["own"].alias("own"),
            ),
        ).otherwise(F.struct(acc["s"].alias("s"), acc["e"].alias("e"), (acc["own"] & (F.getbit(F.col("__p.i"), bit) == 0)).alias("own"))),
    )
    out = grown.withColumn("__w", walk).where("__w.own")
    return out.withColumns({start: F.col("__w.s"), end: F.col("__w.e")}).drop("__p", "__w")


def _covering(df: DataFrame, key: list[str], start: str, end: str, out: str, spread: bool) -> DataFrame:
    """df with how many rows of its key start before its end, less those that end at its start or before: what overlaps it,
    itself included (where it has a length). No pairs are made."""
    at = F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("s"), F.lit(0).alias("e")), F.struct(F.col(end).alias("at"), F.lit(0).alias("s"), F.lit(1).alias("e"))))
    steps = df.select(*key, at.alias("x")).groupBy(*key, "x.at").agg(F.sum("x.s").alias("s"), F.sum("x.e").alias("e"))
    sums = running_sums(steps, key, "at", {"__s": "s", "__e": "e"}, spread)
    started = sums.select(*key, F.col("at").alias(end), (F.col("__s") - F.col("s")).alias("__started"))
    ended = sums.select(*key, F.col("at").alias(start), F.col("__e").alias("__ended"))
    return df.join(started, [*key, end]).join(ended, [*key, start]).withColumn(out, F.col("__started") - F.col("__ended")).drop("__started", "__ended")


def without_overlaps(df: DataFrame, key: str = "key", owner: str = "owner", start: str = "start", end: str = "end", spread: bool = False) -> DataFrame:
    """Rows that overlap no row of another owner under the same key: those that all rows cover no more often than their
    owner's own do. Sweeps over starts and ends, so the work grows with the rows, not with their overlaps."""
    each = df.groupBy(key, owner, start, end).agg(F.count("*").alias("__n"))  # equal rows count once
    both = _covering(_covering(each, [key], start, end, "__all", spread), [key, owner], start, end, "__own", spread)
    alone = both.where(F.col("__all") == F.col("__own")).select(key, owner, start, end)
    return df.join(alone, [key, owner, start, end], "left_semi")


def bins_touched(start: Column, end: Column, stride: int, majority: bool = True) -> Column:
    """The output bins of a range: by rounding half to even (a bin counts if about half of it is covered), or any."""
    if majority:
        first, last = F.rint(start / stride).cast("bigint"), F.rint(end / stride).cast("bigint")
    else:
        first, last = F.floor(start / stride).cast("bigint"), F.ceil(end / stride).cast("bigint")
    return F.when(last > first, F.sequence(first, last - 1)).otherwise(F.array().cast("array<bigint>"))


def masked_bins(windows: DataFrame, regions: DataFrame, pool: int, key: str = "key", edge: float = 0.1, width: int = 64) -> DataFrame:
    """Bins of windows (start, end) that regions (r_start, r_end) touch; an edge bin of which a region covers less than
    the share is left out."""
    met = overlap_join(windows, regions, key, ("start", "end"), ("r_start", "r_end"), width)
    s, e = F.greatest(F.col("r_start") - F.col("start"), F.lit(0)), F.least(F.col("r_end"), F.col("end")) - F.col("start")
    met = met.withColumns({"__f": F.floor(s / pool).cast("bigint"), "__l": F.ceil(e / pool).cast("bigint"), "__s": s, "__e": e})
    first = F.col("__f") + F.when(1 - (F.col("__s") % pool) / pool < edge, 1).otherwise(0)
    last = F.col("__l") - F.when((F.col("__e") % pool != 0) & ((F.col("__e") % pool) / pool < edge), 1).otherwise(0)
    met = met.withColumns({"__first": first, "__last": last}).where("__last > __first")
    return met.withColumn("bin", F.explode(F.sequence("__first", F.col("__last") - 1))).drop("__f", "__l", "__s", "__e", "__first", "__last", "overlap", "r_start", "r_end").distinct()


def chain(df: DataFrame, distance: int, key: str = "key", pos: str = "pos", spread: bool = False) -> DataFrame:
    """Cluster numbers (from 1 in each key): rows closer than the distance (at least 1) to their neighbour are linked."""
    d = running(dealt(df, [key], pos, spread), [key], [pos], {"__last": ("last", F.col(pos))}, spread)
    marked = _islands(d, key, [pos], F.when(F.col(pos) - F.col("__last") < distance, 0).otherwise(1), spread)
    return marked.withColumnRenamed("__island", "cluster").drop("__last")


def _folded(df: DataFrame, key: str, pos: str, apart: float, spread: bool, step, schema: str) -> DataFrame:
    """A fold over each key's positions (with n, how many rows have one) in order. Where the next is `apart` or more away a
    new fold begins, so that a key is dealt out by its gaps; each part streams through its task in bounded memory. step: a
    function of a stream of (new, pos, n) that gives rows of first columns."""
    kind = df.schema[key].dataType.simpleString()
    counted = df.groupBy(key, F.col(pos).cast("bigint").alias("__p")).agg(F.count("*").alias("__n"))
    d = running(dealt(counted, [key], "__p", spread), [key], ["__p"], {"__last": ("last", F.col("__p"))}, spread)
    marked = _islands(d, key, ["__p"], F.when(F.col("__p") - F.col("__last") < apart, 0).otherwise(1), spread)
    laid = marked.select(F.col(key).alias("key"), F.col("__island").alias("part"), F.col("__p").alias("p"), F.col("__n").alias("n"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = laid.repartition(n, "key", "part").sortWithinPartitions("key", "part", "p")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = None, None
        for batch in batches:
            keys, out = batch.column(0), []
            names = keys.to_pylist()
            for k, part, p, n in zip(names, *(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                if last != (k, part):
                    if state is not None:
                        out.append((last[0], *state))
                    state, last = None, (k, part)
                state, done = step(state, p, n)
                if done is not None:
                    out.append((k, *done))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], keys.type), *(pa.array([o[c] for o in out], pa.int64()) for c in (1, 2))], names=["key", "a", "b"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]], keys.type), pa.array([state[0]], pa.int64()), pa.array([state[1]], pa.int64())], names=["key", "a", "b"])

    return laid.mapInArrow(over, f"key {kind}, a bigint, b bigint").select(F.col("key").alias(key), *[F.expr(x) for x in schema.split(", ")])


def greedy(df: DataFrame, reach: float, key: str = "key", pos: str = "pos", spread: bool = False) -> DataFrame:
    """(key, first, n): a cluster takes positions until one is reach or more from its first. A gap of the reach always ends
    one, so a key is dealt out by those; between them the fold is ordered by nature."""

    def step(state, p, n):
        if state is None:
            return (p, n), None
        return ((p, n), state) if p >= state[0] + reach else ((state[0], state[1] + n), None)

    return _folded(df, key, pos, reach, spread, step, "a as first, b as n")


def running_mean_clusters(df: DataFrame, distance: float, key: str = "key", pos: str = "pos", spread: bool = False) -> DataFrame:
    """(key, mean, n): a position joins the open cluster if it is within the distance of the cluster's mean so far. A gap
    over the distance always ends a cluster, so a key is dealt out by those."""

    def step(state, p, n):  # rows of one position follow each other: the first may open a cluster, which the others join
        if state is None:
            return (p * n, n), None
        return ((state[0] + p * n, state[1] + n), None) if p - state[0] / state[1] <= distance else ((p * n, n), state)

    made = _folded(df, key, pos, math.nextafter(distance, math.inf), spread, step, "a as total, b as n")
    return made.select(key, (F.col("total") / F.col("n")).alias("mean"), "n")


def runs(df: DataFrame, low: Column, key: str = "key", pos: str = "pos", min_rows: int = 1, spread: bool = False) -> DataFrame:
    """(key, first, last, n) of runs of neighbouring rows where low holds; the last run counts as well."""
    marked = dealt(df.withColumn("__low", F.coalesce(low, F.lit(False))), [key], pos, spread)
    high = F.when(F.col("__low"), 0).otherwise(1)
    kept = running(marked, [key], [pos], {"__run": ("sum", high)}, spread).where("__low")  # rows of a run have as many high ones before them
    return kept.groupBy(key, "__run").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count("*").alias("n")).where(F.col("n") >= min_rows).drop("__run")


def disjoin(df: DataFrame, key: str = "key", start: str = "start", end: str = "end", value: str = "value", spread: bool = False) -> DataFrame:
    """Overlapping valued intervals as disjoint ones with the mean of what covers them: a sweep over starts and ends, so
    the work grows with the rows, not with their overlaps."""
    ends = df.select(key, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("n"), F.col(value).alias("v")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("n"), (-F.col(value)).alias("v")))).alias("x"))
    steps = ends.groupBy(key, "x.at").agg(F.sum("x.n").alias("n"), F.sum("x.v").alias("v"))
    swept = running(dealt(steps, [key], "at", spread), [key], ["at"], {"__depth": ("sum", F.col("n")), "__total": ("sum", F.col("v")), "__next": ("next", F.col("at"))}, spread)
    swept = swept.select(key, F.col("at").alias(start), F.col("__next").alias(end), (F.col("__depth") + F.col("n")).alias("depth"), (F.col("__total") + F.col("v")).alias("__total"))
    return swept.where((F.col("depth") > 0) & F.col(end).isNotNull()).withColumn("mean", F.col("__total") / F.col("depth")).drop("__total")


def recentre(start: Column, end: Column, length: int) -> tuple[Column, Column]:
    """The window of this length about the middle."""
    first = F.floor((start + end) / 2).cast("bigint") - length // 2
    return first, first + length


def curated_peaks(df: DataFrame, pool: int, crop: int, key: str = "key", start: str = "start", end: str = "end") -> DataFrame:
    """Peaks of at least one pool plus both crops, merged where they touch, with their length rounded up to whole pools
    about the middle."""
    least = pool + 2 * crop
    short = F.col(end) - F.col(start) < least
    first, last = recentre(F.col(start), F.col(end), least)
    grown = df.select(key, F.when(short, first).otherwise(F.col(start)).alias(start), F.when(short, last).otherwise(F.col(end)).alias(end))
    merged = merge(grown, key, start, end)
    size = F.ceil((F.col(end) - F.col(start)) / pool).cast("bigint") * pool
    first = F.floor((F.col(start) + F.col(end)) / 2).cast("bigint") - F.floor(size / 2).cast("bigint")
    return merged.select(key, F.greatest(first, F.lit(0).cast("bigint")).alias(start), (F.greatest(first, F.lit(0).cast("bigint")) + size).alias(end))


def grid_first(df: DataFrame, order: list[str], key: str = "key", start: str = "start") -> DataFrame:
    """Of rows on one grid that share a bin, the first by the order."""
    w = Window.partitionBy(key, start).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def far_from_ends(df: DataFrame, lengths: DataFrame, distance: int, key: str = "key", start: str = "start", end: str = "end", length: str = "length") -> DataFrame:
    """Rows at least the distance from both ends of their key; lengths has one row for each key."""
    return df.join(lengths, key).where((F.col(start) >= distance) & (F.col(end) <= F.col(length) - distance)).drop(length)


def offsets(lengths: DataFrame, key: str = "key", length: str = "length") -> DataFrame:
    """The place of each key's position 0 when all are laid end to end, in the order of the keys."""
    w = Window.orderBy(key)  # one row for each chromosome
    return lengths.withColumn("offset", F.sum(length).over(w) - F.col(length))


#: Chromosomes, about, that a broadcast may have.
FEW = 100_000


def from_offset(places: DataFrame, laid: DataFrame, place: str = "place", key: str = "key") -> DataFrame:
    """places with the key and the position in it, the inverse of offsets (key, length, offset). Few keys, as chromosomes
    are, are joined by the range that holds the place; many are swept together with the places."""
    ranges = laid.select(F.col("offset").alias("o"), (F.col("offset") + F.col("length")).alias("e"), F.col(key).alias("k"))
    if laid.limit(FEW + 1).count() <= FEW:
        met = places.join(F.broadcast(ranges), (F.col(place) >= F.col("o")) & (F.col(place) < F.col("e")))
        return met.withColumns({key: F.col("k"), "pos": F.col(place) - F.col("o")}).drop("o", "e", "k")
    rows = places.select(F.col(place).alias("__at"), F.lit(1).alias("__side"), F.lit(None).alias("__own"), F.struct(*places.columns).alias("__row"))
    marks = ranges.select(F.col("o").alias("__at"), F.lit(0).alias("__side"), F.struct("o", "e", "k").alias("__own"), F.lit(None).alias("__row"))
    swept = dealt(marks.unionByName(rows), [], "__at", True)
    found = running(swept, [], ["__at", "__side"], {"__last": ("max", F.col("__own"))}, True).where("__side = 1 and __at < __last.e")
    return found.select("__row.*", F.col("__last.k").alias(key), (F.col("__at") - F.col("__last.o")).alias("pos"))
