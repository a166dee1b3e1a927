"""Phrases whose words stand together: frequent n-grams by Misra-Gries summaries, counted exactly, scored by their weakest cut.

Summaries find which n-grams may be frequent; they never decide a count. One pass
each for words, for pairs of surviving words, and for longer runs of surviving pairs
(a frequent run has only frequent parts). A last pass counts the survivors as text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordprism.llm import words as W
from wordprism.plans.spread import deal
from wordprism.plans.tables import stored

LEAST = 30  # occurrences of a candidate
LONGEST = 4  # words of a candidate
COVERED = 80  # percent of a candidate's occurrences inside a longer one that drop it
TOP = 2000  # phrases reported per language
FACTOR = 2_000_000  # of the score
NO_LANGUAGE = "und"
COUNTERS = 1 << 20  # of a hash partition's summary: 16 MB
BUFFER = 3 << 20  # n-grams that a task gathers into one set of summaries
MOST_BITS = 1 << 27  # of a filter of survivors: 16 MB, whatever the corpus
_SALTS = 64
_STEP = np.arange(64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C17)  # sets lengths apart

#: ``[^\x20\x09]+`` within pieces between ``[.,;:!?\x0A-\x0D]``
BREAK = np.zeros(256, dtype=bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD = ~BREAK
WORD[[0x20, 0x09]] = False


@dataclass
class Filter:
    """A fixed-size bit table of 64-bit hashes with two probes: no false negative."""

    bits: np.ndarray
    exponent: int

    def has(self, grams: np.ndarray) -> np.ndarray:
        high, low = grams >> np.uint64(64 - self.exponent), grams & np.uint64((1 << self.exponent) - 1)
        return self._one(high) & self._one(low)

    def _one(self, at: np.ndarray) -> np.ndarray:
        return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def survivor_filter(grams: DataFrame) -> Filter:
    """The filter of all rows of ``grams`` (gram); about 16 bits each up to MOST_BITS."""
    bits = 1 << 12
    size = grams.count()
    while bits < min(16 * size, MOST_BITS):
        bits *= 2
    exponent = bits.bit_length() - 1
    probes = F.array(F.shiftrightunsigned("gram", 64 - exponent), F.col("gram").bitwiseAND(F.lit(bits - 1)))
    spots = grams.select(F.explode(probes).alias("spot"))
    mask = F.expr("shiftleft(1L, cast(spot & 63 as int))")
    words = spots.groupBy(F.shiftright("spot", 6).cast("int").alias("at")).agg(F.bit_or(mask).alias("mask")).toArrow()
    table = np.zeros(bits // 64, dtype=np.uint64)
    table[words.column("at").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    return Filter(table, exponent)


def _language_hash(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


@dataclass
class Text:
    """Words of a slice of documents: the piece each stands in and the hash of its language."""

    found: W.Words
    piece: np.ndarray
    language: np.ndarray

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``k`` words within a piece."""
        at = np.arange(max(len(self.piece) - k + 1, 0))
        at = at[self.piece[at] == self.piece[at + k - 1]]
        return at, W.mix(W.grams(self.found.hash, k)[at] + self.language[at] + _STEP[k])


def read(part: pa.RecordBatch) -> Text:
    found = W.find(part.column("text"), WORD, lower=True)
    names = pc.dictionary_encode(part.column("lang"))
    hashes = np.array([_language_hash(n) for n in names.dictionary.to_pylist()], dtype=np.uint64)
    doc = found.doc()
    breaks = np.concatenate([[0], np.cumsum(BREAK[found.data])])
    new = np.ones(len(doc), dtype=np.int64)
    if len(doc):
        new[1:] = (breaks[found.start[1:]] > breaks[found.end[:-1]]) | (doc[1:] != doc[:-1])
    return Text(found, np.cumsum(new), hashes[names.indices.to_numpy()[doc]] if len(doc) else np.empty(0, np.uint64))


def _possible(text: Text, level: int, longest: int, filters: list[Filter]) -> list[np.ndarray]:
    """Hashes of the n-grams that a level's summaries take in: those whose parts survived."""
    if level == 1:
        return [text.grams(1)[1]]
    size = len(text.piece)
    ok = np.zeros(size + longest, dtype=bool)
    at, grams = text.grams(level - 1)
    ok[at] = filters[-1].has(grams)
    out = []
    for k in [2] if level == 2 else range(3, longest + 1):
        at, grams = text.grams(k)
        keep = ok[at]
        for i in range(1, k - level + 2):
            keep &= ok[at + i]
        out.append(grams[keep])
    return out


def _planes(values: np.ndarray) -> bytes:
    """Sorted numbers byte by byte, highest bytes together, which shuffle compression takes well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).reshape(-1)


def _summaries(level: int, longest: int, parts: int, filters):
    """Per task and hash partition: small exact summaries, ready to be merged."""

    def pack(held: list[np.ndarray]) -> pa.RecordBatch:
        grams, counts = np.unique(np.concatenate(held), return_counts=True)
        owner = ((grams >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        own, first = np.unique(owner, return_index=True)
        ends = np.append(first[1:], len(grams))
        rows = [(_planes(grams[a:b]), counts[a:b].astype(np.uint32).tobytes()) for a, b in zip(first, ends)]
        return pa.RecordBatch.from_arrays(
            [pa.array(own.astype(np.int32)), pa.array([g for g, _ in rows], pa.binary()), pa.array([c for _, c in rows], pa.binary())],
            names=["part", "grams", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = filters.value
        held, size = [], 0
        for batch in batches:
            for part in W.slices(batch):
                new = _possible(read(part), level, longest, known)
                held += new
                size += sum(len(x) for x in new)
                if size >= BUFFER:
                    yield pack(held)
                    held, size = [], 0
        if size:
            yield pack(held)

    return run


class Summary:
    """Misra-Gries counters of one hash partition.

    ``taken`` is what all decrements together may have taken from one counter: at
    most mass / (capacity + 1). With a capacity above mass / threshold it stays below
    the threshold, so that every frequent n-gram keeps a counter. Should a
    partition get more mass than planned, the capacity doubles where a decrement
    would reach the threshold: memory grows, nothing is lost.
    """

    def __init__(self, threshold: int, capacity: int):
        self.threshold, self.capacity, self.taken = threshold, capacity, 0
        self.grams, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self._new: list[tuple[np.ndarray, np.ndarray]] = []
        self._waiting = 0

    def add(self, grams: np.ndarray, counts: np.ndarray) -> None:
        self._new.append((grams, counts))
        self._waiting += len(grams)
        if self._waiting >= self.capacity:
            self.merge()

    def merge(self) -> None:
        grams = np.concatenate([self.grams, *(g for g, _ in self._new)])
        counts = np.concatenate([self.counts, *(c for _, c in self._new)])
        self._new, self._waiting = [], 0
        order = np.argsort(grams)
        grams, counts = grams[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.empty(0, np.int64)
        self.grams, self.counts = grams[first], np.add.reduceat(counts, first) if len(first) else counts
        while len(self.grams) > self.capacity:
            least = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            if self.taken + least >= self.threshold:
                self.capacity *= 2
                continue
            self.taken += least
            keep = self.counts > least
            self.grams, self.counts = self.grams[keep], self.counts[keep] - least

    def survivors(self) -> np.ndarray:
        """Every n-gram that may reach the threshold."""
        self.merge()
        return self.grams[self.counts + self.taken >= self.threshold]


def _merge(threshold: int, capacity: int):
    """Merge the summaries of each hash partition as they stream by, one partition after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, summary = None, None
        for batch in batches:
            for part, grams, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if part != current:
                    if summary:
                        yield pa.RecordBatch.from_arrays([pa.array(summary.survivors().view(np.int64))], names=["gram"])
                    current, summary = part, Summary(threshold, capacity)
                summary.add(
                    _numbers(np.frombuffer(grams.as_buffer(), np.uint8)), np.frombuffer(counts.as_buffer(), np.uint32).astype(np.int64)
                )
        if summary:
            yield pa.RecordBatch.from_arrays([pa.array(summary.survivors().view(np.int64))], names=["gram"])

    return run


def _counted(longest: int, filters):
    """Survivors as text with their counts in a slice, and the words of each language (k = 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = filters.value
        for batch in batches:
            for part in W.slices(batch):
                text = read(part)
                data, start, end = W.joined(text.found, WORD)
                doc = text.found.doc()
                firsts, sizes, times = [], [], []
                for k in range(1, longest + 1):
                    at, grams = text.grams(k)
                    keep = known[min(k, 3) - 1].has(grams)
                    _, first, count = np.unique(grams[keep], return_index=True, return_counts=True)
                    firsts.append(at[keep][first])
                    sizes.append(np.full(len(first), k))
                    times.append(count)
                first, size, count = (np.concatenate(x) for x in (firsts, sizes, times))
                length = end[first + size - 1] - start[first]
                offsets = np.concatenate([[0], np.cumsum(length)])
                phrase = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[W.ragged(start[first], length)]))
                languages = part.column("lang")
                total = pa.table({"lang": languages, "n": np.diff(text.found.row)}).group_by("lang").aggregate([("n", "sum")])
                names, sums = total.column("lang").combine_chunks(), total.column("n_sum").combine_chunks()
                yield pa.RecordBatch.from_arrays([
                    pa.concat_arrays([languages.take(pa.array(doc[first])), names]).cast(pa.string()),
                    pa.concat_arrays([phrase.cast(pa.string()), pa.array([""] * len(names), pa.string())]),
                    pa.array(np.concatenate([size, np.zeros(len(names))]).astype(np.int32)),
                    pa.concat_arrays([pa.array(count.astype(np.int64)), sums.cast(pa.int64())]),
                ], names=["lang", "phrase", "k", "f"])

    return run


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, counters: int = COUNTERS) -> DataFrame:
    """``lang, phrase, k, f``: runs of 1 to ``longest`` words with f >= ``least``, and per language its number of words (k = 0).

    n-grams are dealt to hash partitions. Every word but the last of a text has a byte
    behind it, so bytes bound the mass; partitions are as many as make ``counters``
    twice the mean mass / least. Very large corpora take more ``counters`` rather
    than millions of partitions. Filters of the survivors have a bounded size; past it
    they let more through to the exact count, which alone decides.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), "text")
    size = texts.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    mass = size // 2 * max(longest - 2, 1)  # of the level with the most n-grams
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * mass // (least * counters)))
    filters: list[Filter] = []
    for level in range(1, min(longest, 3) + 1):
        shared = spark.sparkContext.broadcast(filters)
        small = texts.mapInArrow(_summaries(level, longest, parts, shared), "part int, grams binary, counts binary")
        merged = deal(small, "part").sortWithinPartitions("part").mapInArrow(_merge(least, counters), "gram long")
        filters = [*filters, survivor_filter(stored(merged, f"survivors-{level}"))]
    rows = texts.mapInArrow(_counted(longest, spark.sparkContext.broadcast(filters)), "lang string, phrase string, k int, f long")
    return stored(rows.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).where(f"f >= {least} or k = 0"), "phrases")


def mine_phrases(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, top: int = TOP, factor: int = FACTOR, counters: int = COUNTERS,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language.

    ``docs`` needs lang and text; other columns are ignored. Texts are lower-cased
    (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words at spaces and
    tabs. A candidate is a run of 2 to ``longest`` words with a >= ``least``
    occurrences; of its cuts in two the one with the lowest floor(factor * a / (l + r))
    counts, the earliest of equals. A candidate goes if a longer one holds it and has
    at least ``covered`` percent of its occurrences.

    Null languages are ``und``. Null, empty or wordless texts count nothing. Repeated
    rows count each time. Equal scores go by a, then by the phrase's bytes. Tables
    without rows, or without candidates, give no rows. Products are decimals of 38 digits.
    """
    found = frequent_phrases(docs, least, longest, counters)
    known = found.where("k > 0").select("lang", "phrase", "f")
    candidates = found.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("_w"))
    cuts = candidates.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)")))
    cuts = cuts.withColumn("_l", F.expr("array_join(slice(_w, 1, cut), ' ')")).withColumn("_r", F.expr("array_join(slice(_w, cut + 1, k - cut), ' ')"))
    cuts = cuts.select("lang", "phrase", "a", "cut", "_l", "_r")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("_l"), F.col("f").alias("l")), ["lang", "_l"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("_r"), F.col("f").alias("r")), ["lang", "_r"])
    score = F.expr(f"(cast(a as decimal(38,0)) * {factor}) div (cast(l as decimal(38,0)) + r)")
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("_c"))
    within = F.expr(
        "flatten(transform(sequence(2, k - 1), n -> transform(sequence(1, k - n + 1), i -> array_join(slice(_w, i, n), ' '))))"
    )
    inside = candidates.where("k > 2").select("lang", F.explode(F.array_distinct(within)).alias("phrase"), F.col("a").alias("_f"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("_f").alias("_f"))
    kept = weakest.join(inside, ["lang", "phrase"], "left")
    kept = kept.where(F.col("_f").isNull() | (F.col("_f").cast("decimal(38,0)") * 100 < F.col("a").cast("decimal(38,0)") * covered))
    kept = kept.select("lang", "phrase", "a", F.col("_c.l").alias("l"), F.col("_c.r").alias("r"), F.col("_c.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    dealt = kept.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))  # a language is ranked in parts first
    few = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    sizes = found.where("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
