"""Column functions of nucleotide strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUCLEOTIDES = "ACGT"


def reverse_complement(seq: Column) -> Column:
    """Case is kept; other letters stay as they are."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def letters(seq: Column) -> Column:
    return F.when(F.length(seq) > 0, F.split(seq, "")).otherwise(F.array().cast("array<string>"))


def indexed(seq: Column) -> Column:
    """A, C, G, T to 0-3, anything else to 4."""
    return F.transform(letters(F.upper(seq)), lambda c: F.coalesce(F.nullif(F.instr(F.lit(NUCLEOTIDES), c), F.lit(0)) - 1, F.lit(4)).cast("tinyint"))


def one_hot(seq: Column, uniform: bool = False) -> Column:
    """Four numbers for each position; other letters are all zero, or where uniform a quarter each."""
    other = F.array(*[F.lit(0.25 if uniform else 0.0)] * 4)
    return F.transform(letters(F.upper(seq)), lambda c: F.when(c.isin(*NUCLEOTIDES), F.array(*[(c == n).cast("double") for n in NUCLEOTIDES])).otherwise(other))


def from_one_hot(hot: Column) -> Column:
    """The letter of the one position that is hot; N where none is."""
    return F.array_join(F.transform(hot, lambda x: F.when(F.array_contains(x, F.lit(1.0)), F.substring(F.lit(NUCLEOTIDES), F.array_position(x, F.lit(1.0)).cast("int"), F.lit(1))).otherwise("N")), "")


def fitted(seq: Column, length: int) -> Column:
    """The middle of a longer sequence; a shorter one with N around it."""
    n = F.length(seq)
    cut = F.substring(seq, F.floor((n - length) / 2).cast("int") + 1, F.lit(length))
    left = F.floor((length - n) / 2).cast("int")
    return F.when(n >= length, cut).otherwise(F.concat(F.repeat(F.lit("N"), left), seq, F.repeat(F.lit("N"), length - n - left)))


def shifted(seq: Column, shift: int) -> Column:
    """Moved to the right (below zero: left), with N for what is missing."""
    n, pad = F.length(seq), F.repeat(F.lit("N"), F.lit(abs(shift)))
    if shift == 0:
        return seq
    return F.left(F.concat(pad, seq), n) if shift > 0 else F.right(F.concat(seq, pad), n)


def inserted(seq: Column, pos: Column | int, new: Column) -> Column:
    """new before the position, the length kept by cutting the end."""
    p = F.lit(pos) if isinstance(pos, int) else pos
    return F.left(F.concat(F.left(seq, p), new, F.substring(seq, p + 1, F.length(seq))), F.length(seq))


def deleted(seq: Column, pos: Column | int, n: Column | int) -> Column:
    """n letters fewer from the position on, the length kept by N at the end."""
    p, n = F.lit(pos) if isinstance(pos, int) else pos, F.lit(n) if isinstance(n, int) else n
    gone = F.greatest(F.least(n, F.length(seq) - p), F.lit(0))
    return F.concat(F.left(seq, p), F.substring(seq, p + n + 1, F.length(seq)), F.repeat(F.lit("N"), gone))


def replaced(seq: Column, pos: Column | int, nt: Column) -> Column:
    p = F.lit(pos) if isinstance(pos, int) else pos
    return F.overlay(seq, nt, p + 1)


def letter_at(seq: Column, pos: Column | int) -> Column:
    return F.substring(seq, (F.lit(pos) if isinstance(pos, int) else pos) + 1, F.lit(1))


def window(chromosome: Column, start: Column, end: Column) -> Column:
    """Positions [start, end) of a chromosome; N for those beyond it."""
    first, n = F.greatest(start, F.lit(0)), F.length(chromosome)
    held = F.substring(chromosome, (first + 1).cast("int"), F.greatest(F.least(end, n) - first, F.lit(0)).cast("int"))
    left = F.least(F.greatest(-start, F.lit(0)), end - start).cast("int")
    return F.concat(F.repeat(F.lit("N"), left), held, F.repeat(F.lit("N"), (end - start - left - F.length(held)).cast("int")))


def capped(allele: Column, cap: int = 5) -> Column:
    return F.when(F.length(allele) > cap, F.concat(F.left(allele, F.lit(cap)), F.lit("*"))).otherwise(allele)


def with_allele(seq: Column, offset: Column, ref: Column, alt: Column) -> Column:
    """The sequence with alt in place of ref at the offset, its length kept: cut at the end, or filled up with N. An
    error where the sequence does not carry ref there."""
    n = F.length(seq)
    fits = F.upper(F.substring(seq, offset + 1, F.length(ref))) == F.upper(ref)
    edited = F.concat(F.left(seq, offset), alt, F.substring(seq, offset + F.length(ref) + 1, n))
    whole = F.rpad(F.left(edited, n), n, F.lit("N"))
    return F.when(fits, whole).otherwise(F.raise_error(F.lit("the sequence does not carry the reference allele")))


def kmers(df: DataFrame, seq: str, k: int, keys: list[str], canonical: bool = True) -> DataFrame:
    """(keys, kmer, n) of all k-mers of letters A, C, G, T; canonical: the lesser of a k-mer and its reverse
    complement."""
    at = F.explode(F.when(F.length(seq) >= k, F.sequence(F.lit(1), F.length(seq) - k + 1)).otherwise(F.array().cast("array<int>")))
    cut = df.select(*keys, F.upper(F.col(seq)).alias("__s"), at.alias("__i")).select(*keys, F.substring("__s", F.col("__i"), F.lit(k)).alias("kmer"))
    cut = cut.where(F.col("kmer").rlike(f"^[ACGT]{{{k}}}$"))
    if canonical:
        cut = cut.withColumn("kmer", F.least("kmer", reverse_complement(F.col("kmer"))))
    return cut.groupBy(*keys, "kmer").agg(F.count("*").alias("n"))


def saturation(df: DataFrame, seq: str, keys: list[str], start: int = 0, end: int | None = None) -> DataFrame:
    """(keys, pos, nt, seq): every single substitution of a range; three for each position, four where it has no
    nucleotide. Rows are keyed by what was changed, never by their order."""
    last = F.length(seq) if end is None else F.least(F.length(seq), F.lit(end))
    at = F.when(last > start, F.sequence(F.lit(start), last - 1)).otherwise(F.array().cast("array<int>"))
    sites = df.select(*keys, F.col(seq).alias("__s"), F.explode(at).alias("pos"))
    each = sites.select("*", F.explode(F.array(*map(F.lit, NUCLEOTIDES))).alias("nt")).where(F.upper(letter_at(F.col("__s"), F.col("pos"))) != F.col("nt"))
    return each.select(*keys, "pos", "nt", replaced(F.col("__s"), F.col("pos"), F.col("nt")).alias(seq))


def position_weights(df: DataFrame, seq: str, keys: list[str], pseudo: float = 1.0) -> DataFrame:
    """(keys, pos, nt, freq): frequencies by position, with a pseudocount for each cell; other letters count a quarter
    each."""
    each = df.select(*keys, F.posexplode(letters(F.upper(F.col(seq)))).alias("pos", "c"))
    counted = each.groupBy(*keys, "pos").agg(F.count("*").alias("__n"), *[(F.sum(F.when(F.col("c") == x, 1.0).when(F.col("c").isin(*NUCLEOTIDES), 0.0).otherwise(0.25)) + pseudo).alias(f"__{x}") for x in NUCLEOTIDES])
    long = counted.select(*keys, "pos", F.explode(F.array(*[F.struct(F.lit(x).alias("nt"), (F.col(f"__{x}") / (F.col("__n") + 4 * pseudo)).alias("freq")) for x in NUCLEOTIDES])).alias("x"))
    return long.select(*keys, "pos", "x.nt", "x.freq")


def information(df: DataFrame, keys: list[str], gc: float = 0.415, halved: bool = False) -> DataFrame:
    """(keys, bits): the sum over positions and nucleotides of p log2(p + 1e-9) - b log2 b, where b is gc for G and C and
    1 - gc for A and T (halved: half of each, so that they sum to one)."""
    b = F.when(F.col("nt").isin("C", "G"), gc).otherwise(1 - gc) / (2 if halved else 1)
    return df.groupBy(*keys).agg(F.sum(F.col("freq") * F.log2(F.col("freq") + 1e-9) - b * F.log2(b)).alias("bits"))


def nucleotide_frequencies(df: DataFrame, seq: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, nt, freq): share of each nucleotide, with one added to each count."""
    keys = keys or []
    counts = [F.sum(F.length(seq) - F.length(F.replace(F.upper(F.col(seq)), F.lit(x)))).alias(f"__{x}") for x in NUCLEOTIDES]
    summed = (df.groupBy(*keys) if keys else df.groupBy()).agg(*counts)
    total = sum((F.coalesce(F.col(f"__{x}"), F.lit(0)) for x in NUCLEOTIDES[1:]), F.coalesce(F.col("__A"), F.lit(0))) + 4
    long = summed.select(*keys, F.explode(F.array(*[F.struct(F.lit(x).alias("nt"), ((F.coalesce(F.col(f"__{x}"), F.lit(0)) + 1) / total).alias("freq")) for x in NUCLEOTIDES])).alias("x"))
    return long.select(*keys, "x.nt", "x.freq")


def cigar_length(cigar: Column) -> Column:
    """Reference bases of a CIGAR string."""
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), F.lit(1)), F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))


def codon_start(frame: Column, pos: Column) -> Column:
    """The start of the codon that holds the position, from an array that is 1 at codons' first bases; null outside."""
    at = lambda k: F.when((pos - k >= 0) & (F.element_at(frame, (pos - k + 1).cast("int")) == 1), pos - k)
    return F.coalesce(at(0), at(1), at(2))


def sized_rna(seq: Column, length: int) -> Column:
    """The last so many letters, or N after a shorter one."""
    return F.when(F.length(seq) >= length, F.right(seq, F.lit(length))).otherwise(F.rpad(seq, length, "N"))


def leading_parenthesis(name: Column) -> Column:
    """The name in parentheses that a label begins with; the label where it has none."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"^\(([^)]*)\)", 1), F.lit("")), name)


def without_version(id: Column) -> Column:
    """Without what follows the last dot."""
    return F.regexp_replace(id, r"\.[^.]*$", "")


def all_kmers(spark: SparkSession, k: int, pseudo: float = 1.0) -> DataFrame:
    """(kmer, n): every k-mer, with its pseudocount; the letters are the digits of its number."""
    digits = F.transform(F.sequence(F.lit(k - 1), F.lit(0)), lambda i: F.substring(F.lit(NUCLEOTIDES), (F.floor(F.col("id") / F.pow(F.lit(4.0), i)) % 4 + 1).cast("int"), F.lit(1)))
    return spark.range(4**k).select(F.array_join(digits, "").alias("kmer"), F.lit(pseudo).alias("n"))


def centred_windows(seq: Column, pos: Column, size: int) -> Column:
    """The letters around a position, with N beyond the ends."""
    start = pos - size // 2
    return window(seq, start, start + size)


def activating_windows(df: DataFrame, seq: str, pos: str, value: str, size: int, group: list[str], share: float | None = None, above: float | None = None) -> DataFrame:
    """Windows around positions whose value is above a threshold: a fixed one, or the group's mean plus the share of what
    its largest value has over it."""
    if above is not None:
        kept = df.where(F.col(value) > above)
    else:
        tops = df.groupBy(*group).agg(F.avg(value).alias("__m"), F.max(value).alias("__x"))
        kept = df.join(tops, group).where(F.col(value) > F.col("__m") + share * (F.col("__x") - F.col("__m"))).drop("__m", "__x")
    return kept.withColumn("kmer", centred_windows(F.col(seq), F.col(pos), size))


def aligned(df: DataFrame, id: str, seq: str, shift: int = 1, rounds: int = 2, pseudo: float = 1.0) -> DataFrame:
    """df with shift: where each sequence of one length fits best to the position weights of all others as they are
    shifted now, after some rounds. Each round is one join of letters with at most 4 * length weights."""
    from lociframe.checkpoint import cut

    now = cut(df.withColumn("shift", F.lit(0)))
    steps = F.explode(F.sequence(F.lit(-shift), F.lit(shift)))
    for _ in range(rounds):
        laid = now.withColumn("__s", _moved(F.col(seq), F.col("shift")))
        weights = position_weights(laid.select(F.lit(0).alias("g"), "__s"), "__s", ["g"], pseudo).select("pos", "nt", F.log(F.col("freq")).alias("w"))
        tried = now.select(id, seq, steps.alias("__k")).select(id, "__k", F.posexplode(letters(F.upper(_moved(F.col(seq), F.col("__k"))))).alias("pos", "nt"))
        scored = tried.join(weights, ["pos", "nt"], "left").groupBy(id, "__k").agg(F.sum(F.coalesce("w", F.log(F.lit(0.25)))).alias("s"))
        best = scored.groupBy(id).agg(F.max_by("__k", F.struct(F.round("s", 9), -F.abs("__k"), "__k")).alias("shift"))
        now = cut(df.join(best, id))
    return now


def _moved(seq: Column, by: Column) -> Column:
    n = F.length(seq)
    return F.when(by > 0, F.left(F.concat(F.repeat(F.lit("N"), by), seq), n)).when(by < 0, F.right(F.concat(seq, F.repeat(F.lit("N"), -by)), n)).otherwise(seq)


def scored_letters(df: DataFrame, seq: str, scores: str) -> DataFrame:
    """(pos, nt, value) for each position of a sequence: its score under its own letter, 0 under the others."""
    each = df.select(*[c for c in df.columns if c not in (seq, scores)], F.posexplode(F.arrays_zip(letters(F.upper(F.col(seq))).alias("c"), F.col(scores).alias("s"))).alias("pos", "x"))
    rest = [c for c in each.columns if c not in ("pos", "x")]
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("nt"), F.when(F.col("x.c") == n, F.col("x.s")).otherwise(0.0).alias("value")) for n in NUCLEOTIDES]))
    return each.select(*rest, "pos", cells.alias("y")).select(*rest, "pos", "y.nt", "y.value")
