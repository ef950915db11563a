"""Byte-level BPE encoding and decoding by a monoid tree reduction.

A piece (one match of the pre-split pattern) is a token as a whole, or it is halved down to tokens and leaves of two bytes
at most, and neighbours are joined by re-encoding a window around their border. A token sequence is the encoding of its
bytes exactly if every two neighbours in it are, alone, encoded as themselves; so a join is final as soon as the window's
two outer pairs pass that test, and until then the window grows. Decoding concatenates the tokens' bytes up a tree.

A part that is a token is taken whole, which is right for tokens that merging their own bytes yields. That is checked
for every token when a vocabulary is loaded; those that it does not yield stand for whole pieces only.

Defined results: a null text counts as empty; an empty text has no ids. Rows, repeats and further columns stay as they
are; an added column replaces one of the same name.
"""

from __future__ import annotations

import base64
import heapq
import struct
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.llm.common import small_batches

#: Pieces that a worker remembers twice over, and bytes of the longest of them. When as many are new as that, those that
#: were neither new nor asked for since the last time are forgotten.
CACHE_PIECES, CACHE_BYTES = 250_000, 64

#: Bytes of the longest halves that are remembered.
HALF_BYTES = 8


class TreeBpe:
    """ranks: token bytes to id, where a lower id merges first; every single byte has one."""

    def __init__(self, ranks: dict[bytes, int], leaf: int = 2):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.ranks, self.leaf = ranks, max(1, leaf)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        sizes = np.array([len(t) for t in self.tokens])
        self._sizes, self._starts, self._bytes = sizes, np.cumsum(sizes) - sizes, np.frombuffer(b"".join(self.tokens), np.uint8)
        self._pairs: dict[tuple[int, int], bool] = {}
        self._halves: dict[bytes, list[int]] = {}
        self.joins = 0  # borders at which two parts were joined
        self.parts = {t: [i] for t, i in ranks.items() if len(t) <= 2 or self._plain(t) == [i]}  # tokens as parts of a piece

    def merge(self, data: bytes) -> list[int]:
        """Plain encoding: the pair of lowest rank merges first, the leftmost of equals."""
        if not data:
            return []
        return list(whole) if (whole := self.parts.get(data)) else self._plain(data)

    def _plain(self, data: bytes) -> list[int]:
        return self._merge_short(data) if len(data) <= 48 else self._merge_long(data)

    def _merge_short(self, data: bytes) -> list[int]:
        get, parts = self.ranks.get, [data[i : i + 1] for i in range(len(data))]
        rank = [get(parts[i] + parts[i + 1], sys.maxsize) for i in range(len(parts) - 1)]
        while rank and (least := min(rank)) != sys.maxsize:
            i = rank.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del rank[i]
            if i < len(rank):
                rank[i] = get(parts[i] + parts[i + 1], sys.maxsize)
            if i:
                rank[i - 1] = get(parts[i - 1] + parts[i], sys.maxsize)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap over a linked list of parts."""
        n, get = len(data), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts here; end 0: merged away
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue  # one of the two has changed since
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (b := before[i]) >= 0 and (r := get(data[b:stop])) is not None:
                heapq.heappush(heap, (r, b, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : end[i]]])
            i = end[i]
        return out

    def pair(self, a: int, b: int) -> list[int]:
        """How the two tokens, side by side, are encoded."""
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) >= CACHE_PIECES:
                self._pairs.clear()
            known = self._pairs[a, b] = self.merge(self.tokens[a] + self.tokens[b])
        return known

    def stable(self, a: int, b: int) -> bool:
        """Whether the two tokens, side by side, are encoded as themselves."""
        known = self.pair(a, b)
        return len(known) == 2 and known[0] == a and known[1] == b

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of both."""
        if not left or not right:
            return left or right
        self.joins += 1
        a, b = left[-1], right[0]
        window = self._pairs.get((a, b)) or self.pair(a, b)
        if len(window) == 2 and window[0] == a and window[1] == b:
            return left + right
        i, j, step = len(left) - 1, 1, 1
        while True:
            fixed_left = i == 0 or self.stable(left[i - 1], window[0])
            fixed_right = j == len(right) or self.stable(window[-1], right[j])
            if fixed_left and fixed_right:
                return left[:i] + window + right[j:]
            if not fixed_left:
                i = max(0, i - step)
            if not fixed_right:
                j = min(len(right), j + step)
            step *= 2
            window = self.merge(b"".join(map(self.tokens.__getitem__, left[i:] + right[:j])))

    def encode(self, data: bytes) -> list[int]:
        """The ids of a piece: of one that is a token that, else what the tree reduction of its bytes gives."""
        return [whole] if (whole := self.ranks.get(data)) is not None else self.reduced(data)

    def reduced(self, data: bytes) -> list[int]:
        if (found := self.parts.get(data)) is not None or (found := self._halves.get(data)) is not None:
            return found
        if len(data) <= self.leaf:
            return self.merge(data)
        middle = len(data) // 2
        out = self.join(self.reduced(data[:middle]), self.reduced(data[middle:]))
        if len(data) <= HALF_BYTES:  # a half of many pieces
            if len(self._halves) >= CACHE_PIECES:
                self._halves.clear()
            self._halves[data] = out
        return out

    def decode(self, ids: np.ndarray | list[int], leaf: int = 1 << 16) -> bytes:
        """The tokens' bytes side by side; leaves are gathered at once."""
        if len(ids) > leaf:
            middle = len(ids) // 2
            return self.decode(ids[:middle], leaf) + self.decode(ids[middle:], leaf)
        ids = np.asarray(ids, np.int64)
        if len(ids) and ids.min() < 0:
            raise IndexError("an id below 0")
        sizes = self._sizes[ids]
        at = np.cumsum(sizes) - sizes
        return self._bytes[np.repeat(self._starts[ids] - at, sizes) + np.arange(sizes.sum())].tobytes()


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: on each line a token in base64 and its rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


class Codec:
    """The encoder of texts that a worker keeps: pattern, tree and remembered pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.tree, self.pieces = TreeBpe(ranks), regex.compile(pattern)
        outer = self

        class Known(dict):
            before: dict[str, bytes] = {}

            def __missing__(self, piece: str) -> bytes:
                packed = self.before.get(piece)
                if packed is None:
                    packed = struct.pack(f"<{len(ids := outer.tree.encode(piece.encode('utf-8', 'surrogatepass')))}I", *ids)
                if len(piece) <= CACHE_BYTES:
                    if len(self) >= CACHE_PIECES:
                        self.before = dict(self)
                        self.clear()
                    self[piece] = packed
                return packed

        self.known = Known()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.pieces.findall(text)))

    def decode(self, packed: bytes) -> bytes:
        return self.tree.decode(np.frombuffer(packed, "<u4"))


_CODECS: dict[tuple[str, str], Codec] = {}


def _codec(name: str, pattern: str) -> Codec:
    if (name, pattern) not in _CODECS:
        with open(SparkFiles.get(name), "rb") as f:
            _CODECS.clear()
            _CODECS[name, pattern] = Codec(read_ranks(f.read()), pattern)
    return _CODECS[name, pattern]


def _ship(df: DataFrame, vocabulary: str) -> str:
    """Give the rank file to every executor; it is read there once for each worker."""
    df.sparkSession.sparkContext.addFile(vocabulary)
    return vocabulary.rsplit("/", 1)[-1]


def _run(df: DataFrame, read: str, make, added: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """df with the columns that make(value of column read) returns for each row."""
    small_batches(df.sparkSession)
    new = {n for n, _, _ in added}
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in new or c == read])
    hide = read in new
    out = kept.drop(read) if hide else kept
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema), *(f"`{n}` {t}" for n, t, _ in added)])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            made = [one(x) for x in batch.column(batch.schema.get_field_index(read)).to_pylist()]
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if not (hide and n == read)}
            columns |= {n: pa.array([m[k] for m in made], t) for k, (n, _, t) in enumerate(added)}
            yield pa.RecordBatch.from_pydict(columns)

    return kept.mapInArrow(over, schema)


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids", count: str = "n_tokens", decoded: str | None = None, packed: bool = False) -> DataFrame:
    """df with the text's ids (array<int>, or where packed their little-endian unsigned 32-bit bytes) and their count;
    where decoded names a column, also the bytes that the ids decode to."""
    name = _ship(df, vocabulary)
    added = [(ids, "binary", pa.binary()) if packed else (ids, "array<int>", pa.list_(pa.int32())), (count, "bigint", pa.int64())]
    if decoded:
        added.append((decoded, "binary", pa.binary()))

    def make():
        codec = _codec(name, pattern)

        def one(value: str | None) -> tuple:
            b = codec.encode(value or "")
            return (b if packed else np.frombuffer(b, "<i4"), len(b) // 4, *([codec.decode(b)] if decoded else []))

        return one

    return _run(df, text, make, added)


def decode(df: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the bytes of each row's array of ids; null ids decode to no bytes, an unknown id raises IndexError."""
    name = _ship(df, vocabulary)

    def make():
        codec = _codec(name, pattern)
        return lambda value: (codec.tree.decode(list(value or [])),)

    return _run(df, ids, make, [(decoded, "binary", pa.binary())])
