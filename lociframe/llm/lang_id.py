"""Language identification by a linear-chain conditional random field over words.

Each word's label depends on its affixes, its character n-grams, itself and the languages whose lexicon of frequent
words has it, and on its neighbour's label by learned transitions. Forward-backward gives every word's label
probabilities; a text's language is that of the largest mean over its words with letters, the mean is its score. Chains
are cut every CHAIN words, so any text is labelled whole in bounded memory.

The field is fitted on a bounded sample (documents of each language by hash, a window of words from each); as texts are
labelled whole, training chains join short runs of words from several documents, from which switches are learned.

Defined results: a null text, or one without a letter, is `und` with score 0, as is every text where nothing could be
learned. Ties go to the language that sorts first. Rows, repeats and further columns
stay; a column that has an added one's name gives way to it.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.llm.common import small_batches

#: Words of a chain, and of a run within a training chain at most.
CHAIN, RUN = 64, 32

#: Hashed features; words that a worker remembers.
WIDTH, KNOWN = 1 << 17, 400_000

#: Bounds of the sample: documents of each language, characters and then words taken from one. Every language is learned.
DOCUMENTS, CHARACTERS, WORDS = 250, 4000, 300

#: Frequent words of a language that form its lexicon.
LEXICON = 300


def core(word: str) -> str:
    """Lower case, without what stands before its first and after its last letter."""
    if word.isalpha():
        return word.lower()
    i, j = 0, len(word)
    while i < j and not word[i].isalpha():
        i += 1
    while j > i and not word[j - 1].isalpha():
        j -= 1
    return word[i:j].lower()


def features(words: list[str], lexicon: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words at once (none empty): which word, hashed feature, and value. Each word has itself, prefixes and
    suffixes of up to three characters, and its pairs and triples of characters, marks at both ends included."""
    text = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) for w in words]) + 2
    starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(words)), sizes)
    spread, one = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)

    def hashed(kind: int, characters: list[np.ndarray]) -> np.ndarray:
        h = np.full(len(characters[0]), kind, np.uint64)
        for c in characters:
            h = (h * one + c) * spread
            h ^= h >> np.uint64(29)
        return (h % np.uint64(WIDTH)).astype(np.int64)

    found = []
    whole = np.add.reduceat(text * spread ** (np.arange(len(text)) - starts[owner] + 1).astype(np.uint64), starts)
    found.append((np.arange(len(words)), hashed(0, [whole]), np.ones(len(words), np.float32)))
    for k in (1, 2, 3):
        held = np.flatnonzero(sizes - 2 >= k)
        for kind, first in ((k, starts[held] + 1), (3 + k, starts[held] + sizes[held] - 1 - k)):
            found.append((held, hashed(kind, [text[first + i] for i in range(k)]), np.ones(len(held), np.float32)))
    scale = np.minimum(1.0, 8.0 / (2 * sizes - 3)).astype(np.float32)
    for k in (2, 3):
        at = np.flatnonzero(owner[: len(text) - k + 1] == owner[k - 1 :])
        found.append((owner[at], hashed(5 + k, [text[at + i] for i in range(k)]), scale[owner[at]]))
    named = [(i, WIDTH + label) for i, w in enumerate(words) if w in lexicon for label in lexicon[w]]
    if named:
        found.append((np.array([i for i, _ in named]), np.array([f for _, f in named]), np.ones(len(named), np.float32)))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


@dataclass
class Field:
    languages: list[str]
    weights: np.ndarray  # features by languages, the lexicons last
    moves: np.ndarray  # label by next label
    lexicon: dict[str, list[int]]

    def emissions(self, words: list[str]) -> np.ndarray:
        out, step = np.zeros((len(words), len(self.languages)), np.float32), max(100, 80_000 // max(1, len(self.languages)))
        for i in range(0, len(words), step):
            part = words[i : i + step]
            owner, ids, values = features(part, self.lexicon)
            drawn = self.weights[ids] * values[:, None]
            for j in range(out.shape[1]):
                out[i : i + step, j] = np.bincount(owner, drawn[:, j], len(part))
        return out


def forward_backward(emissions: np.ndarray, mask: np.ndarray, moves: np.ndarray, learn: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """emissions: chains by steps by labels; mask: which steps are words (the first of each chain is one). Label
    probabilities of each step, and where learn, the expected number of each move."""
    psi, a = np.exp(emissions - emissions.max(2, keepdims=True)), np.exp(moves)
    chains, steps, labels = psi.shape
    alpha, scale = np.empty_like(psi), np.ones((chains, steps), psi.dtype)
    now = psi[:, 0]
    for t in range(steps):
        if t:
            now = np.where(mask[:, t, None], (now @ a) * psi[:, t], now)
        total = now.sum(1)
        if t:
            total = np.where(mask[:, t], total, 1)
        scale[:, t] = total
        now = now / total[:, None]
        alpha[:, t] = now
    out, expected = np.empty_like(psi), np.zeros((labels, labels))
    beta = np.ones((chains, labels), psi.dtype)
    out[:, -1] = alpha[:, -1]
    for t in range(steps - 2, -1, -1):
        ahead = psi[:, t + 1] * beta / scale[:, t + 1, None]
        if learn:
            expected += (alpha[:, t].T @ (ahead * mask[:, t + 1, None])) * a
        beta = np.where(mask[:, t + 1, None], ahead @ a.T, beta)
        out[:, t] = alpha[:, t] * beta
    return out, expected


def fit(texts: list[tuple[str, str]], rounds: int = 40, rate: float = 0.2, shrink: float = 1e-4, seed: int = 44) -> Field:
    """texts: (language, text). Maximum likelihood with a small quadratic penalty, by Adam over all chains at once."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for lang, _ in texts})
    runs: list[tuple[int, list[str]]] = []
    for lang, text in texts:
        words = [w for w in map(core, text.split()) if w]
        at = int(rng.integers(0, max(1, len(words) - WORDS + 1)))
        words = words[at : at + WORDS]
        while words:
            n = int(rng.integers(1, RUN + 1))
            runs.append((languages.index(lang), words[:n]))
            words = words[n:]
    frequent = [Counter() for _ in languages]
    for label, words in runs:
        frequent[label].update(words)
    lexicon: dict[str, list[int]] = {}
    for label, counts in enumerate(frequent):
        for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon.setdefault(w, []).append(label)
    n = len(languages)
    field = Field(languages, np.zeros((WIDTH + n, n), np.float32), np.zeros((n, n)), lexicon)
    if n < 2 or not runs:
        return field
    order = rng.permutation(len(runs))
    labels = np.concatenate([np.full(len(runs[k][1]), runs[k][0]) for k in order])
    words = list(itertools.chain.from_iterable(runs[k][1] for k in order))
    types = {w: k for k, w in enumerate(dict.fromkeys(words))}
    owner, ids, values = features(list(types), lexicon)
    used, ids = np.unique(ids, return_inverse=True)
    chains = -(-len(words) // CHAIN)
    at = np.zeros(chains * CHAIN, np.int64)
    at[: len(words)] = [types[w] for w in words]
    gold = np.zeros((chains * CHAIN, n), np.float32)
    gold[np.arange(len(words)), labels] = 1
    mask = (np.arange(chains * CHAIN) < len(words)).reshape(chains, CHAIN)
    at, gold = at.reshape(chains, CHAIN), gold.reshape(chains, CHAIN, n)
    seen = np.einsum("cti,ctj->ij", gold[:, :-1], gold[:, 1:])
    w, moves = np.zeros((len(used), n)), np.zeros((n, n))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, moves)]
    for k in range(1, rounds + 1):
        drawn = w[ids] * values[:, None]
        table = np.stack([np.bincount(owner, drawn[:, j], len(types)) for j in range(n)], 1)
        found, expected = forward_backward(table[at], mask, moves, True)
        gap = ((found - gold) * mask[:, :, None]).reshape(-1, n)
        by_type = np.stack([np.bincount(at.ravel(), gap[:, j], len(types)) for j in range(n)], 1)
        slope = np.stack([np.bincount(ids, values * by_type[owner, j], len(used)) for j in range(n)], 1) / len(words)
        for x, g, (m, v) in ((w, slope + shrink * w, state[0]), (moves, (expected - seen) / len(words) + shrink * moves, state[1])):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            x -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    field.weights[used] = w
    field.moves = moves
    return field


def sample(docs: DataFrame, id: str, text: str, lang: str, learn: Column) -> list[tuple[str, str]]:
    """At most DOCUMENTS rows of each language, those of the smallest hash."""
    whole, hashed = F.col(f"`{text}`"), F.xxhash64(F.col(f"`{id}`").cast("string"))
    part = F.substring(whole, F.pmod(hashed, F.greatest(F.char_length(whole) - CHARACTERS, F.lit(1))).cast("int") + 1, F.lit(CHARACTERS))
    rows = docs.where(learn & F.col(f"`{lang}`").isNotNull() & whole.isNotNull()).select(hashed.alias("h"), F.col(f"`{lang}`").alias("lang"), part.alias("text"))
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text")))
    return sorted((r["lang"], r["text"]) for r in ranked.where(F.col("k") <= DOCUMENTS).select("lang", "text").collect())


def label(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """docs with lang_pred and score in place of the text."""
    small_batches(docs.sparkSession)
    columns = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    given = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text}`").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1]), "lang_pred string", "score double"])
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader.of(shared.value)
        for batch in batches:
            pred, score = reader.label(batch.column(len(columns)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*columns, "lang_pred", "score"])

    return given.mapInArrow(over, schema)


def keep_known(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """docs, as they are, without those that are `und`; where no language was learned, without those that have no
    letter."""
    if not field.languages:
        return docs.where(F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False)))
    small_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(field), docs.columns.index(text)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader.of(shared.value)
        for batch in batches:
            pred, _ = reader.label(batch.column(at).to_pylist())
            yield batch.filter(pa.array([p != "und" for p in pred], pa.bool_()))
        Reader.now = None  # its words would stay with the worker, which serves later stages

    return docs.mapInArrow(over, docs.schema)


class Reader:
    """What a worker keeps of a field: the emissions of words that it has met. Row 0 is a word without letters."""

    now: Reader | None = None

    @classmethod
    def of(cls, field: Field) -> Reader:
        if cls.now is None or cls.now.field is not field:
            cls.now = cls(field)
        return cls.now

    def __init__(self, field: Field):
        self.field = field
        self.reset()

    def reset(self) -> None:
        self.rows, self.cores = {}, {"": 0}
        self.table = np.zeros((1024, len(self.field.languages)), np.float32)

    def add(self, words: set[str]) -> None:
        fresh: list[str] = []
        for w in words:
            c = core(w)
            k = self.cores.get(c)
            if k is None:
                k = self.cores[c] = len(self.cores)
                fresh.append(c)
            self.rows[w] = k
        if len(self.cores) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((len(self.cores), self.table.shape[1]), np.float32)])
        if fresh:
            self.table[len(self.cores) - len(fresh) : len(self.cores)] = self.field.emissions(fresh)

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names = self.field.languages
        pred, score = ["und"] * len(texts), [0.0] * len(texts)
        at = 0
        while names and at < len(texts):  # as many texts at once as have 200,000 words, one at least
            stop, words, sizes = at, [], []
            while stop < len(texts) and (stop == at or len(words) < 200_000):
                own = (texts[stop] or "").split()
                words += own
                sizes.append(len(own))
                stop += 1
            if len(self.rows) >= KNOWN:
                self.reset()
            if new := set(words).difference(self.rows):
                self.add(new)
            index = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
            sums, letters = self.sums(index, np.array(sizes))
            for k in np.flatnonzero(letters):
                best = int(sums[k].argmax())
                pred[at + k], score[at + k] = names[best], min(1.0, float(sums[k, best] / letters[k]))
            at = stop
        return pred, score

    def sums(self, index: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, the label probabilities summed over its words with letters, and their number."""
        n, chains = len(self.field.languages), -(-sizes // CHAIN)
        out, letters = np.zeros((len(sizes), n)), np.zeros(len(sizes), np.int64)
        starts, first = np.cumsum(sizes) - sizes, np.cumsum(chains) - chains
        owner = np.repeat(np.arange(len(sizes)), chains)
        offset = starts[owner] + (np.arange(len(owner)) - first[owner]) * CHAIN
        length = np.minimum(CHAIN, (starts + sizes)[owner] - offset)
        step = max(1, min(4096, 400_000 // n))  # chains at once: no more memory where languages are many
        for i in range(0, len(owner), step):
            o, m = offset[i : i + step], np.arange(CHAIN) < length[i : i + step, None]
            w = np.where(m, index[np.minimum(o[:, None] + np.arange(CHAIN), len(index) - 1)], 0)
            found, _ = forward_backward(self.table[w], m, self.field.moves.astype(np.float32))
            held = m & (w > 0)
            np.add.at(out, owner[i : i + step], (found * held[:, :, None]).sum(1, dtype=np.float64))
            np.add.at(letters, owner[i : i + step], held.sum(1))
        return out, letters


def identify(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", learn: Column | None = None) -> DataFrame:
    """docs with lang_pred and score; learned from the rows where learn holds (default: all) and lang is not null."""
    return label(docs, fit(sample(docs, id, text, lang, F.lit(True) if learn is None else learn)), text)
