"""SimHash near-dedup by the generalised pigeonhole principle.

A fingerprint has 64 bits; bit k is set if over half the hashes of the text's shingles (repeats included) have it. Two
fingerprints that differ in at most d bits, with the bits in m partitions and thresholds that sum to d - m + 1, differ
within the threshold in one partition at least. The bits that agree most often are put together; the number of
partitions and their thresholds come from a dynamic program over estimated candidate counts, from the bit counts of
all fingerprints. Each fingerprint is filed under its bits of every partition and looks up those within the threshold;
what meets is verified.

Only distinct fingerprints are compared. A group that meets gives a spanning forest of its links, not all pairs, and a
group of over BLOCK rows is dealt out in pairs of blocks, so no task holds an unbounded group and no link is lost.

Defined results: words are [^\\x20\\x09-\\x0D]+ after A-Z are lower-cased; fewer words than a shingle give one shingle of
them all; none (null, empty) give fingerprint zero, linked like any other. Rows and repeats stay. A component's id is
its smallest doc id; nulls only where it has no other.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.llm.common import cut, own_prefix, small_batches
from lociframe.llm.components import components
from lociframe.llm.repeats import bitmap, mark

BITS = 64

#: Rows of a group that one task compares.
BLOCK = 2048

#: Cost of a looked-up row against one verified pair.
ROW_COST = 100.0

#: Rows of a block whose shingle sets one task holds.
OPEN = 256

#: Options of similar_groups and drop_similar.
SIMILAR = {"words": 5, "similarity": 0.8, "bits": 512, "recall": 0.98}


def shingle_hashes(text: str | None, words: int = 4, seed: int = 42) -> np.ndarray:
    import xxhash

    found, digest = (text or "").encode("utf-8", "surrogatepass").lower().split(), xxhash.xxh64_intdigest  # bytes: only A-Z, only \x20\x09-\x0D
    if len(found) < words:
        return np.array([digest(b" ".join(found), seed)] if found else [], "<u8")
    whole = b" ".join(found)
    ends = list(itertools.accumulate(map(len, found), lambda x, n: x + n + 1))
    starts = itertools.chain((0,), (x + 1 for x in ends))
    return np.fromiter((digest(whole[i:j], seed) for i, j in zip(starts, ends[words - 1 :], strict=False)), "<u8", len(found) - words + 1)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th stream of hashes; the first is h itself."""
    if not k:
        return h
    x = h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def fold(hashes: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    """Fingerprints, as rows of 64-bit words, for arrays of hashes."""
    out = np.zeros((len(hashes), bits // BITS), "<u8")
    at = 0
    while at < len(hashes):
        stop, n = at, 0
        while stop < len(hashes) and (stop == at or n + len(hashes[stop]) <= 100_000):
            n += len(hashes[stop])
            stop += 1
        sizes = np.array([len(h) for h in hashes[at:stop]])
        held = np.flatnonzero(sizes)
        counts = np.zeros((len(held), bits), np.int64)
        if len(held) == 1:  # perhaps a very long text
            h = hashes[at + held[0]]
            for i in range(0, len(h), 100_000):
                counts += _counts(h[i : i + 100_000], np.array([len(h[i : i + 100_000])]), bits)
        elif len(held):
            counts = _counts(np.concatenate(hashes[at:stop]), sizes[held], bits)
        out[at + held] = np.packbits(2 * counts > sizes[held][:, None], axis=1, bitorder="little").view("<u8")
        at = stop
    return out


def _counts(h: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
    """For each run of h of these sizes, how many hashes have each bit. Up to 255 rows of single bits are added as bytes,
    eight at a time."""
    parts = -(-sizes // 255)
    first = np.cumsum(parts) - parts
    within = np.arange(parts.sum()) - np.repeat(first, parts)
    starts = np.repeat(np.cumsum(sizes) - sizes, parts) + 255 * within
    out = []
    for k in range(bits // BITS):
        single = np.unpackbits(np.ascontiguousarray(_mixed(h, k)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(single.view("<u8"), starts, axis=0).view(np.uint8)
        out.append(np.add.reduceat(sums, first, axis=0, dtype=np.int64))
    return np.concatenate(out, 1)


def fingerprints(docs: DataFrame, text: str = "text", words: int = 4, bits: int = BITS, repeats: bool = True) -> DataFrame:
    """docs with the column fp in place of the text: a bigint of 64 bits, or the bytes of more. Without repeats each
    shingle of a text counts once, as in its shingle set."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (text, "fp")]
    given = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1]), f"fp {'bigint' if bits == BITS else 'binary'}"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(t, words) for t in batch.column(len(kept)).to_pylist()]
            fp = _column(fold(hashes if repeats else [np.unique(h) for h in hashes], bits))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], fp], names=[*kept, "fp"])

    return given.mapInArrow(over, schema)


def _column(fps: np.ndarray) -> pa.Array:
    return pa.array(fps[:, 0].view("<i8")) if fps.shape[1] == 1 else pa.array([x.tobytes() for x in fps], pa.binary())


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """Fingerprints as rows of 64-bit words."""
    if width == BITS:
        return np.ascontiguousarray(column.to_numpy(zero_copy_only=False)).view("<u8").reshape(-1, 1)
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, width // BITS)


def _single(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")


def agreement(fps: DataFrame, bits: int = BITS) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and for each two bits how many have both set: a row for each bit comes back."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((bits, bits)), 0
        for batch in batches:
            b = _single(_rows(batch.column(0), bits)).astype(np.float32)
            total += b.T @ b
            n += len(b)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(bits)), pa.array([n] * bits), pa.array(list(total))], names=["bit", "n", "both"])

    def summed(t: pa.Table) -> pa.Table:
        both = np.sum(np.array(t.column("both").to_pylist()), 0)
        return pa.table({"bit": t.column("bit")[:1], "n": pa.array([sum(t.column("n").to_pylist())]), "both": pa.array([both])})

    schema = "bit bigint, n bigint, both array<double>"
    count, both = 0, np.zeros((bits, bits))
    for r in fps.select("fp").mapInArrow(over, schema).groupBy("bit").applyInArrow(summed, schema).collect():
        count, both[r["bit"]] = r["n"], r["both"]
    return count, both


def group_bits(count: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of the bits: each grows by the bit that is most correlated with those it has."""
    n = len(both)
    p = np.diag(both) / max(1, count)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    phi = np.abs((both / max(1, count) - np.outer(p, p)) / np.outer(spread, spread))
    free, out = np.ones(n, bool), []
    for k in range(m):
        size = n // m + (k < n % m)
        near = phi[:, free].sum(1)
        own: list[int] = []
        for _ in range(size):
            best = int(np.where(free, near, -np.inf).argmax())
            near = phi[:, best] if not own else near + phi[:, best]
            own.append(best)
            free[best] = False
        out.append(sorted(own))
    return out


def _within(differ: np.ndarray, most: int) -> np.ndarray:
    """Probability of at most 0, 1, ... differing bits, where bit k differs with differ[k]."""
    at = np.zeros(most + 1)
    at[0] = 1
    for x in differ:
        at[1:] = at[1:] * (1 - x) + at[:-1] * x
        at[0] *= 1 - x
    return np.cumsum(at)


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 (costs[k][0]) of the least cost, with total as the sum of thresholds plus one."""
    table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for done, (cost, chosen) in table.items():
            for t, own in enumerate(c, -1):
                if (s := done + t + 1) <= total and (s not in following or cost + own < following[s][0]):
                    following[s] = (cost + own, [*chosen, t])
        table = following
    return table[total]


def plan(count: int, both: np.ndarray, distance: int, partitions: list[int] | None = None, most: int | None = None, near: float = 0.0, recall: float = 0.0) -> list[tuple[list[int], int]]:
    """Partitions with their thresholds (-1: not looked up) of the least estimated cost. All within distance are found;
    where recall is given, the distance grows until so much of what has each bit differ with probability near is."""
    p = np.diag(both) / max(1, count)
    differ = 2 * p * (1 - p)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in partitions or range(1, distance + 2):
        groups = group_bits(count, both, m)
        top = distance if most is None else most
        costs, found = [], []  # of each partition, by threshold from -1
        for own in groups:
            within, looked = _within(differ[own], top), np.cumsum([math.comb(len(own), t) for t in range(top + 1)])
            costs.append([0.0, *(ROW_COST * count * looked[t] + 0.5 * count * count * within[t] for t in range(top + 1))])
            found.append([0.0, *_within(np.full(len(own), near), top)])
        for total in range(distance + 1, m * (top + 1) + 1):
            cost, chosen = allocate(costs, total)
            if 1 - math.prod(1 - f[t + 1] for f, t in zip(found, chosen, strict=True)) >= recall:
                if best is None or cost < best[0]:
                    best = (cost, list(zip(groups, chosen, strict=True)))
                break
    if best is None:
        raise ValueError("no plan has that recall")
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _filed(part: int, mask: Column):
    return lambda x: F.struct(F.lit(part).cast("tinyint").alias("part"), F.col("fp").bitwiseAND(mask).bitwiseXOR(x).alias("key"), (x == 0).alias("own"))


def _signatures(fps: DataFrame, planned: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, own, fp): where each fingerprint is filed (own) and looked up."""
    entries: list[Column] = []
    for k, (bits, t) in enumerate(planned):
        if t < 0:
            continue
        mask = F.lit(_signed(sum(1 << b for b in bits)))
        flips = [_signed(sum(1 << b for b in c)) for n in range(t + 1) for c in itertools.combinations(bits, n)]
        text = F.split(F.lit(",".join(map(str, flips))), ",").cast("array<bigint>")
        entries.append(F.transform(text, _filed(k, mask)))
    return fps.select("fp", F.explode(F.concat(*entries)).alias("s")).select("s.part", "s.key", "s.own", "fp")


def _wide_signatures(fps: DataFrame, planned: list[tuple[list[int], int]], bits: int) -> DataFrame:
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                column = batch.column(0).slice(i, 1000)
                single = _single(_rows(column, bits)).astype(np.int64)
                for part, (own, t) in enumerate(planned):
                    if t < 0:
                        continue
                    key = single[:, own] @ (1 << np.arange(len(own)))
                    flips = np.array([sum(1 << b for b in c) for n in range(t + 1) for c in itertools.combinations(range(len(own)), n)])
                    n = len(flips)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(key) * n, part, np.int16)), pa.array((key[:, None] ^ flips).ravel()), pa.array(np.tile(flips == 0, len(key))), column.take(pa.array(np.repeat(np.arange(len(key)), n)))],
                        names=["part", "key", "own", "fp"],
                    )

    return fps.select("fp").mapInArrow(over, "part smallint, key bigint, own boolean, fp binary")


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int32)


def _forest(fps: np.ndarray, own: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of links that connect what a group's links connect: each fingerprint is reached once."""
    a, b, left = [], [], np.arange(len(fps))
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = _apart(fps[left], fps[x]) <= distance
            if not own[x]:
                near &= own[left]
            if near.any():
                hit = left[near]
                a.append(np.full(len(hit), x))
                b.append(hit)
                front.extend(hit)
                left = left[~near]
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _square(fps: np.ndarray, own: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for a group of moderate size, all pairs at once; few of them are links as a rule."""
    a, b = np.nonzero(np.triu((_all_apart(fps, fps) <= distance) & (own[:, None] | own[None, :]), 1))
    return (a, b) if len(a) <= 2 * len(fps) else _forest(fps, own, distance)


def _all_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    apart = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0]).astype(np.int32)
    for k in range(1, x.shape[1]):
        apart += np.bitwise_count(x[:, None, k] ^ y[None, :, k])
    return apart


def _doubtful(fps: np.ndarray, own: np.ndarray, distance: int, most: int, linked: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of over distance and at most most bits apart that join what the group's links leave apart: of every two
    parts that meet the closest pair, a minimum spanning forest by rounds of nearest neighbours. Fewer than the rows."""
    label = list(range(len(fps)))

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for x, y in zip(linked[0].tolist(), linked[1].tolist(), strict=True):
        label[root(y)] = root(x)
    far = np.iinfo(np.uint16).max
    apart = np.empty((len(fps), len(fps)), np.uint16)
    for i in range(0, len(fps), 256):
        d = _all_apart(fps[i : i + 256], fps)
        apart[i : i + 256] = np.where((d <= most) & (own[i : i + 256, None] | own[None, :]), d, far)
    a, b = [], []
    while True:
        part = np.array([root(x) for x in range(len(fps))])
        least, at = np.full(len(fps), far), np.zeros(len(fps), np.int64)
        for i in range(0, len(fps), 256):
            open_ = np.where(part[i : i + 256, None] != part[None, :], apart[i : i + 256], far)
            at[i : i + 256] = open_.argmin(1)
            least[i : i + 256] = open_[np.arange(len(open_)), at[i : i + 256]]
        rows = np.flatnonzero(least < far)
        rows = rows[np.lexsort((rows, least[rows], part[rows]))]
        rows = rows[np.r_[True, part[rows][1:] != part[rows][:-1]]] if len(rows) else rows
        joined = False
        for x in rows.tolist():  # each part's closest pair
            if (p := root(x)) != (q := root(y := int(at[x]))):
                label[q] = p
                a.append(x)
                b.append(y)
                joined = True
        if not joined:
            return np.array(a, np.int64), np.array(b, np.int64)


def _verify(group: np.ndarray, own: np.ndarray, fps: np.ndarray, distance: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of links within runs of the same group number, and whether each is sure (within distance) or doubtful (within
    most). Small groups are compared pair by pair, all at once."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    a, b, sure = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]

    def add(x: np.ndarray, y: np.ndarray, known: np.ndarray) -> None:
        a.append(x)
        b.append(y)
        sure.append(known)

    for s, n in zip(starts[sizes > 32], sizes[sizes > 32], strict=True):
        part, held = fps[s : s + n], own[s : s + n]
        found = _square(part, held, distance) if n <= 400 else _forest(part, held, distance)
        add(found[0] + s, found[1] + s, np.ones(len(found[0]), bool))
        if most > distance:
            x, y = _doubtful(part, held, distance, most, found)
            add(x + s, y + s, np.zeros(len(x), bool))
    small = np.repeat(sizes <= 32, sizes)
    after = np.repeat(starts + sizes, sizes) - np.arange(len(group)) - 1  # rows of the group that follow
    for k in range(1, 32):
        i = np.flatnonzero(small & (after >= k))
        if not len(i):
            break
        i = i[own[i] | own[i + k]]
        apart = _apart(fps[i], fps[i + k])
        i, apart = i[apart <= most], apart[apart <= most]
        add(i, i + k, apart <= distance)
    return np.concatenate(a), np.concatenate(b), np.concatenate(sure)


def _parts(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of groups of over 32, of which not all pairs come out: the rows that links join to two others or more, and the
    first row of what each belongs to."""
    large = np.bincount(group)[group[a]] > 32
    label: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := label.setdefault(x, x)) != x:
            label[x] = label[y]
            x = y
        return x

    for x, y in zip(a[large].tolist(), b[large].tolist(), strict=True):
        p, q = root(x), root(y)
        label[max(p, q)] = min(p, q)
    rows = np.array(sorted(label), np.int64)
    first = np.array([root(x) for x in rows.tolist()], np.int64)
    held = np.bincount(first)[first] > 2 if len(first) else np.zeros(0, bool)
    return rows[held], first[held]


def links(fps: DataFrame, distance: int = 4, bits: int = BITS, planned: list[tuple[list[int], int]] | None = None, most: int | None = None, parts: bool = False) -> DataFrame:
    """(a, b, sure): links that connect every two distinct fingerprints that differ in at most distance bits and that the
    plan brings together (without one of its own: all), directly or through others. Where most is larger, also pairs up to
    it, not sure: all of a small group, of a larger one the closest that join what its links leave apart. With parts, also
    rows (a, part, name) for the fingerprints a of what is joined in a larger group, where not all pairs come out."""
    most = distance if most is None else most
    planned = planned or plan(*agreement(fps, bits), distance)
    signatures = _signatures(fps, planned) if bits == BITS else _wide_signatures(fps, planned, bits)
    sizes = signatures.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = signatures.join(sizes, ["part", "key"]).withColumn("blocks", F.expr(f"cast((n + {BLOCK - 1}) div {BLOCK} as int)"))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, block).alias("p"), F.greatest(x, block).alias("q")))
    dealt = met.withColumn("s", F.explode(pairs)).select("part", "key", "s.p", "s.q", "own", "fp")  # one row where there is one block
    keys = ["part", "key", "p", "q"]
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, *keys).sortWithinPartitions(*keys)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def done(held: list[pa.RecordBatch], last: bool) -> tuple[pa.RecordBatch | None, list[pa.RecordBatch]]:
            t = pa.Table.from_batches(held).combine_chunks()
            k = [t.column(c).to_numpy() for c in keys]
            new = np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in k])]
            stop = len(new) if last else int(np.flatnonzero(new)[-1])
            if not stop:
                return None, t.to_batches()
            column, group = t.column("fp").slice(0, stop).combine_chunks(), np.cumsum(new[:stop])
            a, b, sure = _verify(group, t.column("own").to_numpy()[:stop], _rows(column, bits), distance, most)
            out = {"a": column.take(pa.array(a)), "b": column.take(pa.array(b)), "sure": pa.array(sure)}
            if parts:
                x, first = _parts(group, a, b)
                names = [xxhash.xxh64_intdigest(repr([int(c[y]) for c in k]).encode() + column[y].as_buffer().to_pybytes()) - (1 << 63) for y in np.unique(first).tolist()]
                names = np.array(names, np.int64)[np.unique(first, return_inverse=True)[1]] if names else np.zeros(0, np.int64)
                more = {"a": column.take(pa.array(x)), "b": pa.nulls(len(x), column.type), "sure": pa.nulls(len(x), pa.bool_())}
                out = {c: pa.concat_arrays([out[c], more[c]]) for c in out}
                out["part"] = pa.array([*[None] * len(a), *k[0][x].tolist()], pa.int16())
                out["name"] = pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(names)])
            return pa.RecordBatch.from_pydict(out), t.slice(stop).to_batches()

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 4 * BLOCK:
                found, held = done(held, False)
                rows = sum(x.num_rows for x in held)
                if found is not None:
                    yield found
        if rows:
            yield done(held, True)[0]

    kind = "bigint" if bits == BITS else "binary"
    schema = f"a {kind}, b {kind}, sure boolean" + (", part smallint, name bigint" if parts else "")
    return dealt.mapInArrow(over, schema).where("b is null or a != b" if parts else "a != b")


def _named(rows: DataFrame, distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with component_id, from the roots (u, v) of fingerprints."""
    rooted = distinct.select("fp", "least").join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))  # on its own, so that a hot root's join can be split
    return rows.drop("component_id").join(rooted.join(ids, "root").select("fp", "component_id"), "fp")


def near_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 4, distance: int = 4) -> DataFrame:
    """docs, without the text, with fp and component_id."""
    rows = cut(fingerprints(docs, text, words))
    distinct = cut(rows.groupBy("fp").agg(F.min(F.col(f"`{id}`")).alias("least")))
    return _named(rows, distinct, components(links(distinct, distance)))


def differing(similarity: float) -> float:
    """The share of bits in which two texts of this Jaccard similarity of shingles differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(h, shingles): the distinct shingle hashes of texts (h, text). h: the text's SHA-256."""
    small_batches(texts.sparkSession, 200)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.unique(shingle_hashes(t, words)).view("<i8") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], names=["h", "shingles"])

    return texts.select("h", "text").mapInArrow(over, "h binary, shingles array<bigint>")


def _named_text(text: str) -> Column:
    """The text's SHA-256, so that no two texts share a name."""
    return F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256))


def _sets(docs: DataFrame, text: str, fps: DataFrame, distinct: DataFrame, words: int) -> DataFrame:
    """(fp, shingles) of fps. Only their texts are read: a bitmap keeps the others from being moved."""
    asked = cut(fps.join(distinct.select("fp", "h"), "fp"))
    held = docs.select(_named_text(text).alias("h"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    found = mark(held, [F.col("h")], bitmap(asked.select("h"), asked.count())).where("__hit").drop("__hit").join(asked, "h", "left_semi")
    sets = shingle_sets(found.groupBy("h").agg(F.any_value("text").alias("text")), words)
    return cut(asked.join(sets, "h").select("fp", "shingles"))


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of fingerprints whose texts have at least this Jaccard similarity."""
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return cut(both.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).drop("x", "y"))


def _similar_pairs(fps: np.ndarray, sets: list[np.ndarray], root: list, masks: list[tuple[np.ndarray, int]], most: int, similarity: float) -> list[tuple[int, int]]:
    """Rows of similar pairs within most bits that join unlike roots. Where a mask before (with its threshold) holds a
    pair, it met and was checked there."""
    names = {r: k for k, r in enumerate(dict.fromkeys(root))}
    part = np.array([names[r] for r in root])
    sizes, out = np.array([len(x) for x in sets]), []
    for i in range(len(fps)):
        j = i + 1 + np.flatnonzero(part[i + 1 :] != part[i])
        j = j[(_apart(fps[j], fps[i]) <= most) & (np.minimum(sizes[j], sizes[i]) >= similarity * np.maximum(sizes[j], sizes[i]))]
        for mask, t in masks:
            j = j[_apart(fps[j] & mask, fps[i] & mask) > t]
        for x in j.tolist():
            if part[x] != part[i]:
                shared = len(np.intersect1d(sets[i], sets[x], assume_unique=True))
                if shared >= similarity * (sizes[i] + sizes[x] - shared):
                    out.append((i, x))
                    part[part == part[x]] = part[i]
    return out


def _rest(found: DataFrame, roots: DataFrame, sets: DataFrame, planned: list[tuple[list[int], int]], bits: int, most: int, similarity: float) -> DataFrame:
    """(ra, rb): roots that are joined by a similar pair of a larger group that did not come out as a link. Only what has
    unlike roots is looked at, in pairs of blocks of OPEN rows, with the shingle sets in the task."""
    rows = _rooted(found.where("name is not null").select("part", "name", F.col("a").alias("fp")), roots)
    several = rows.groupBy("name").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).where("least != most")
    met = cut(rows.join(several.select("name", "n"), "name")).withColumn("blocks", F.expr(f"cast((n + {OPEN - 1}) div {OPEN} as int)"))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, block).alias("p"), F.greatest(x, block).alias("q")))
    dealt = met.join(sets, "fp").withColumn("s", F.explode(pairs)).select("part", "name", "s.p", "s.q", "fp", "root", "shingles")
    masks = [(np.packbits(np.isin(np.arange(bits), own), bitorder="little").view("<u8"), t) for own, t in planned]

    def over(t: pa.Table) -> pa.Table:
        root = t.column("root").combine_chunks()
        held = t.column("shingles").combine_chunks()
        own = [np.asarray(held[k].values).view("<u8") for k in range(len(held))]
        before = [(m, d) for m, d in masks[: t.column("part")[0].as_py()] if d >= 0]
        hit = _similar_pairs(_rows(t.column("fp").combine_chunks(), bits), own, root.to_pylist(), before, most, similarity)
        return pa.table({c: root.take(pa.array([h[k] for h in hit], pa.int64())) for k, c in enumerate(("ra", "rb"))})

    return cut(dealt.groupBy("part", "name", "p", "q").applyInArrow(over, "ra binary, rb binary").distinct())


def _rooted(rows: DataFrame, roots: DataFrame, fp: str = "fp", root: str = "root") -> DataFrame:
    """rows with the root of a fingerprint, from the roots (u, v)."""
    return rows.join(roots.select(F.col("u").alias(fp), F.col("v").alias(root)), fp, "left").withColumn(root, F.coalesce(root, fp))


def _similar(docs: DataFrame, id: str, text: str, words: int, similarity: float, bits: int, recall: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs, without the text, with fp; the distinct fp with their least id; and the roots (u, v) of similar groups."""
    f = differing(similarity)
    spread = math.sqrt(bits * f * (1 - f))
    name = f"{own_prefix(docs)}h"
    rows = cut(fingerprints(docs.withColumn(name, _named_text(text)), text, words, bits, repeats=False))
    distinct = cut(rows.groupBy("fp").agg(F.min(F.col(f"`{id}`")).alias("least"), F.min(name).alias("h")))
    planned = plan(*agreement(distinct, bits), 0, [16, 20, 24, 28, 32, 36, 40, 46], 1, f, recall)
    most = int(f * bits + 2.5 * spread)
    every = cut(links(distinct, int(f * bits - 2 * spread), bits, planned, most, parts=True))
    found = every.where("b is not null")
    sets = _sets(docs, text, found.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), distinct, words)
    # most near links lead to their group's root by a similar text: only links between what that leaves apart are left
    stars = components(found.where("sure")).select(F.col("u").alias("a"), F.col("v").alias("b"))
    roots = _confirmed(stars, sets, similarity).select(F.col("a").alias("u"), F.col("b").alias("v"))
    pairs = _rooted(_rooted(found.select("a", "b").distinct(), roots, "a", "ra"), roots, "b", "rb").where("ra != rb")
    new = _confirmed(pairs, sets, similarity).select("ra", "rb")
    roots = components(_joined(roots, new))
    rest = _rest(every, roots, sets, planned, bits, most, similarity)
    return rows.drop(name), distinct, roots if rest.isEmpty() else components(_joined(roots, rest))


def _joined(roots: DataFrame, new: DataFrame) -> DataFrame:
    return roots.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(new.select(F.col("ra").alias("a"), F.col("rb").alias("b")))


def similar_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """near_groups for texts of at least this Jaccard similarity of their shingle sets. Wider fingerprints, in which each
    shingle of a text counts once, estimate it: pairs up to two and a half deviations farther than it comes to meet, and
    every link is confirmed on the shingle sets. In a group of over 32 that is first done where two parts meet closest, then
    for every pair between what is still apart. The plan finds so much of the pairs that just have it, nearly all that have more, whatever their number."""
    return _named(*_similar(docs, id, text, **(SIMILAR | options)))


def drop_similar(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row of each group of similar texts: that of the smallest id (of rows that share it, that of the
    smallest content hash). A group is known by its root fingerprint, so ids that are null or repeated join no groups."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    content = F.concat(_named_text(text), F.unhex(F.hex(F.xxhash64(*columns))))  # of unlike texts never the same
    hashed = docs.select(F.col(f"`{id}`").alias("id"), content.alias("content"), F.col(f"`{text}`").alias("text"))
    rows, _, roots = _similar(hashed, "id", "text", **(SIMILAR | options))
    best = _rooted(rows, roots).groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "content")).alias("best"))
    own, key = (f"{own_prefix(docs)}{x}" for x in ("id", "content"))
    best = best.select(F.col("best.id").alias(own), F.col("best.content").alias(key))
    kept = docs.withColumn(key, content).join(best, key).where(F.col(f"`{id}`").eqNullSafe(F.col(own)))
    return kept.dropDuplicates([key]).select(*columns)
