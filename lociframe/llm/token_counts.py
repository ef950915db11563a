"""Token counts by a linear longest-match automaton.

The vocabulary's pieces form two tries: those that open a word and those that go on in it. Every node knows where to go
on when the next byte fits none of its children (its failure link) and how many pieces of the greedy longest-match
split that move completes (its pops). So a word's count is had in one pass over its bytes, without building pieces.

A word is a run of [^\\x20\\x09-\\x0D]; it is matched with the opening mark before it. A word that the vocabulary cannot
spell counts as one unknown piece. Defined results: a null or empty text has no words and no pieces. Rows, repeats and
further columns stay; a column that has an added one's name gives way to it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.llm.bpe import read_ranks
from lociframe.llm.common import small_batches

#: Words that a worker remembers, and bytes of the longest of them.
KNOWN, KNOWN_BYTES = 250_000, 64


class Automaton:
    """opening: pieces at the start of a word, going_on: pieces within it."""

    def __init__(self, opening: Iterable[bytes], going_on: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]  # 0: the start, 1: within a word
        self.link = [-1, -1]
        self.pops = [0, 0]
        ends: set[int] = set()
        for root, pieces in ((0, opening), (1, going_on)):
            for piece in pieces:
                node = root
                for c in piece:
                    if (child := self.next[node].get(c)) is None:
                        child = self.next[node][c] = len(self.next)
                        self.next.append({})
                        self.link.append(-1)
                        self.pops.append(0)
                    node = child
                if piece:
                    ends.add(node)
        queue = deque([0, 1])
        while queue:  # by depth, so links lead to nodes that are done
            node = queue.popleft()
            for c, child in self.next[node].items():
                queue.append(child)
                if child in ends:
                    self.link[child], self.pops[child] = 1, 1
                    continue
                to, pops = self.link[node], self.pops[node]
                while to >= 0 and c not in self.next[to]:
                    pops += self.pops[to]
                    to = self.link[to]
                if to >= 0:
                    self.link[child], self.pops[child] = self.next[to][c], pops

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest-match split; -1 where there is none."""
        node, total, following, link, pops = 0, 0, self.next, self.link, self.pops
        for c in word:
            while (child := following[node].get(c)) is None:
                total += pops[node]
                node = link[node]
                if node < 0:
                    return -1
            node = child
        while node > 1:
            total += pops[node]
            node = link[node]
        return total if node == 1 or not word else -1


def split_vocabulary(ranks: Iterable[bytes], mark: bytes = b" ") -> tuple[list[bytes], list[bytes]]:
    """Pieces that begin with the mark open a word, those without any blank go on in it."""
    tokens = list(ranks)
    return [t for t in tokens if t.startswith(mark) and len(t[len(mark) :].split()) <= 1], [t for t in tokens if t and t.split() == [t]]


class Counts(dict):
    """Count of each word met; the memory is emptied when full."""

    def __init__(self, automaton: Automaton, mark: bytes = b" "):
        self.automaton, self.mark = automaton, mark

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(self.mark + word)
        if len(word) <= KNOWN_BYTES:
            if len(self) >= KNOWN:
                self.clear()
            self[word] = n
        return n

    def of(self, text: str | None) -> tuple[int, int, int]:
        """Words, pieces (an unknown word is one), unknown words."""
        words = (text or "").encode("utf-8", "surrogatepass").split()
        found = list(map(self.__getitem__, words))
        unknown = found.count(-1)
        return len(words), sum(found) + 2 * unknown, unknown


_COUNTS: dict[str, Counts] = {}


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """df with n_words, n_tokens and n_unknown in place of the text. vocabulary: a rank file, of whose tokens those with
    a leading space open words."""
    small_batches(df.sparkSession)
    df.sparkSession.sparkContext.addFile(vocabulary)
    name, new = vocabulary.rsplit("/", 1)[-1], ("n_words", "n_tokens", "n_unknown")
    columns = [c for c in df.columns if c != text and c not in new]
    given = df.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text}`").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1]), *(f"{n} bigint" for n in new)])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _COUNTS:
            with open(SparkFiles.get(name), "rb") as f:
                _COUNTS[name] = Counts(Automaton(*split_vocabulary(read_ranks(f.read()))))
        counts = _COUNTS[name]
        for batch in batches:
            made = [counts.of(t) for t in batch.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *(pa.array([m[k] for m in made], pa.int64()) for k in range(3))], names=[*columns, *new])

    return given.mapInArrow(over, schema)
