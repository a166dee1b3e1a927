"""Near-duplicate documents by b-bit MinHash: bands find candidates, packed low bits estimate, whole sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordprism.llm import words as W
from wordprism.llm.components import components
from wordprism.plans.tables import stored

SHINGLE = 5
PERCENT = 85
BANDS, ROWS = 38, 5  # a pair of similarity 0.85 shares no band with probability (1 - 0.85**5)**38 = 2e-10
BITS = 2  # low bits kept of each minimum
LOST = 1e-9  # probability with which the estimate may turn down a pair right at the threshold
PARITY = 1024  # bits that count the members of a set modulo 2, for an exact bound on the difference of two sets
FIRST_BANDS = 6  # bands whose links are joined up before the other bands are looked at
MEETINGS = 8  # most further star passes, each over one drawn class per bucket
CROWD = 512  # classes of one band that one task compares with the rest of it

_NODE = "xxhash64(fp1, fp2, n)"  # number of a class
_SECOND = np.uint64(0x5851F42D4C957F2D)


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = W.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n] | np.uint64(1), seeds[n:]


def _sets(part: pa.RecordBatch, shingle: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending. A text with fewer words is one shingle."""
    found = W.find(part.column("text"), W.NOT_SPACE, lower=True)
    grams = W.grams(found.hash, shingle)
    out = []
    for begin, end in zip(found.row[:-1].tolist(), found.row[1:].tolist()):
        if end - begin >= shingle:
            out.append(np.unique(grams[begin:end - shingle + 1]))
        else:
            out.append(W.grams(found.hash[begin:end], end - begin) ^ np.uint64(end - begin) if end > begin else np.empty(0, np.uint64))
    return out


def minima(sets: list[np.ndarray], n: int) -> np.ndarray:
    """``[set, i]``: upper half of the least value that hash function i takes on the set (sets are not empty)."""
    values = np.concatenate(sets)
    begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), n), dtype=np.uint32)
    for i, (times, flip) in enumerate(zip(*_multipliers(n))):
        out[:, i] = np.minimum.reduceat((values ^ flip) * times, begin) >> np.uint64(32)
    return out


def packed(least: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes of the low bits: word ``p * words + j`` holds bit p of minima 64 * j to 64 * j + 63."""
    rows, n = least.shape
    size = -(-n // 64)
    planes = np.zeros((rows, bits, size * 64), dtype=bool)
    for p in range(bits):
        planes[:, p, :n] = (least >> np.uint32(p)) & np.uint32(1) == 1
    return np.packbits(planes.reshape(rows, -1), axis=1, bitorder="little").view(np.uint64)


def parities(sets: list[np.ndarray], bits: int = PARITY) -> np.ndarray:
    """Per set, whether the number of its members in each of ``bits`` hash buckets is odd."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    spot = (np.concatenate(sets) % np.uint64(bits)).astype(np.int64)
    odd = np.bincount(row * bits + spot, minlength=len(sets) * bits) & 1
    return np.packbits(odd.astype(bool).reshape(len(sets), bits), axis=1, bitorder="little").view(np.uint64)


def _band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(least), bands), dtype=np.uint64)
    for band in range(bands):
        key = np.full(len(least), band + 1, dtype=np.uint64)
        for i in range(band * rows, (band + 1) * rows):
            key = W.mix(key * np.uint64(0x9E3779B97F4A7C17) + least[:, i])
        keys[:, band] = key
    return keys


def _lists(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.reshape(-1).view(np.int64)))


def _fingerprints(sets: list[np.ndarray]) -> list[pa.Array]:
    """Two 64-bit sums over each set; with its size they stand for the set."""
    one = np.array([s.sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
    two = np.array([W.mix(s ^ _SECOND).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
    return [pa.array(one.view(np.int64)), pa.array(two.view(np.int64))]


def _sign(shingle: int, bands: int, rows: int, bits: int):
    names = ["doc_id", "n", "fp1", "fp2", "bits", "odd", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                sets = _sets(part, shingle)
                size = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(size)
                least = np.zeros((len(sets), bands * rows), dtype=np.uint32)
                if len(full):
                    least[full] = minima([sets[i] for i in full], bands * rows)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(size), *_fingerprints(sets), _lists(packed(least, bits)), _lists(parities(sets)),
                    _lists(_band_keys(least, bands, rows)),
                ], names=names)

    return run


def _full_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                sets = _sets(part, shingle)
                one, two = _fingerprints(sets)
                items = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in sets], pa.int64()), one, two, items], names=["n", "fp1", "fp2", "items"])

    return run


def least_matches(n: int, bits: int, percent: int, lost: float = LOST) -> int:
    """Most equal low-bit groups of ``n`` that may be asked for, so that a pair at the threshold fails with at most ``lost``.

    Two minima agree with the similarity s, and unequal ones still agree in their low
    bits with 2**-bits: the expected share of matches is s + (1 - s) * 2**-bits.
    """
    s = percent / 100
    p = s + (1 - s) * 2.0**-bits
    below, m = 0.0, 0
    while True:
        below += math.comb(n, m) * p**m * (1 - p) ** (n - m)
        if below > lost:
            return m
        m += 1


def matches(a: Column, b: Column, n: int, bits: int) -> Column:
    """Number of the ``n`` minima whose low bits agree: one bit count per packed word."""
    size = -(-n // 64)
    word = lambda side, p, j: F.element_at(side, p * size + j + 1)
    unequal = (reduce(lambda x, y: x.bitwiseOR(y), (word(a, p, j).bitwiseXOR(word(b, p, j)) for p in range(bits))) for j in range(size))
    return F.lit(n) - reduce(lambda x, y: x + y, (F.bit_count(x) for x in unequal))


def estimate(matched: Column, n: int, bits: int) -> Column:
    """Similarity behind a number of matches, corrected for minima that agree in their low bits by chance."""
    chance = 2.0**-bits
    return (matched / F.lit(float(n)) - F.lit(chance)) / F.lit(1.0 - chance)


def _alike(a: str, b: str, percent: int, n: int, bits: int) -> Column:
    """Length filter, estimate and parity bound for two ``struct(node, n, bits, odd)``.

    Two sets differ in at least as many members as their parities differ in bits.
    """
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    enough = matches(F.col(f"{a}.bits"), F.col(f"{b}.bits"), n, bits) >= F.lit(least_matches(n, bits, percent))
    words = range(1, PARITY // 64 + 1)
    apart = reduce(lambda x, y: x + y, (F.bit_count(F.element_at(f"{a}.odd", j).bitwiseXOR(F.element_at(f"{b}.odd", j))) for j in words))
    few = (100 + percent) * apart <= (100 - percent) * (na + nb)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & enough & few


def _pairs(a: str, b: str) -> list[Column]:
    return [F.least(f"{a}.node", f"{b}.node").alias("a"), F.greatest(f"{a}.node", f"{b}.node").alias("b")]


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("ia"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("ib"))
    both = F.size(F.array_intersect("ia", "ib"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("ia") + F.size("ib") - both)).select("a", "b")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, bits: int = BITS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (doc_id, text; other columns are ignored).

    Two documents link when ``100 * |common shingles| >= percent * |union|`` on their
    whole sets; a component is what links reach, named by its smallest doc_id.

    1. Equal sets are one class. A class carries ``bands`` band keys and the packed
       low bits of its bands * rows minima; the minima themselves are dropped.
    2. Star pass: every class meets the class that is most often the smallest, and
       the one most often the largest, in its bands' buckets. What passes length,
       estimate and parity is verified on the whole sets. Large groups of close
       copies fall into components here, with two pairs a class.
    3. Further star passes, over buckets that still hold several components: every class
       meets a drawn class of another component, the one it shares most buckets with, until
       a pass links nothing. They join up groups whose pairs link only in part,
       again with one pair a class.
    4. Across pass, for the first bands and then for the others: in buckets that still
       hold several components, all classes of different components meet. A large
       bucket is dealt to blocks of about ``CROWD`` classes, each of which meets the
       bucket in a task of its own. Pairs within a component can't change it and
       are not looked at.

    A linking pair is missed with a probability of about 1e-9 (no common band, or an
    estimate in the far tail). Null or wordless texts: 0 shingles, a component of
    their own. Null doc_id: the row links like any other but names nothing; a
    component without any id has component_id null and all its rows are kept. Rows
    that repeat an id and its text agree in all columns; rows that repeat an id with
    other texts are documents of their own. No rows give no rows.
    """
    n = bands * rows
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(
        docs.mapInArrow(_sign(shingle, bands, rows, bits), "doc_id long, n long, fp1 long, fp2 long, bits array<long>, odd array<long>, keys array<long>"), "signatures"
    ).withColumn("node", F.expr(_NODE))
    named = signed.where("n > 0")
    first = F.any_value(F.struct("n", "bits", "odd", "keys"))  # the same in every row of a class
    classes = stored(named.groupBy("node").agg(F.min("doc_id").alias("name"), first.alias("c")).select("node", "name", "c.*"), "classes")
    places = classes.select("node", F.posexplode("keys").alias("band", "key"))
    ends = places.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high")
    met = stored(places.join(ends, "key"), "meetings")
    card = classes.select("node", F.struct("node", "n", "bits", "odd").alias("card"))
    by_id = lambda name: card.select(F.col("node").alias(name), F.col("card").alias(f"card_{name}"))

    def nearest(shared: DataFrame, tested: DataFrame | None = None) -> DataFrame:
        """Of rows ``node, side, end, shared`` the end per class and side with most shared buckets, as pairs that look alike."""
        best = shared.groupBy("node", "side").agg(F.max(F.struct("shared", "end")).alias("best")).select("node", "best.end")
        pairs = best.select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        return pairs.join(by_id("a"), "a").join(by_id("b"), "b").where(_alike("card_a", "card_b", percent, n, bits)).select("a", "b")

    star = met.select("node", F.posexplode(F.array("low", "high")).alias("side", "end")).where("node != end")
    star = nearest(star.groupBy("node", "side", "end").agg(F.count(F.lit(1)).alias("shared")))

    names = classes.select("node", "name")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """Whole sets of the wanted classes, read from the row that names a class, or from those without an id."""
        chosen = names.join(wanted, "node", "left_semi").where("name is not null").select(F.col("name").alias("doc_id")).distinct()
        mine = docs.join(chosen, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
        found = mine.select("text").mapInArrow(_full_sets(shingle), "n long, fp1 long, fp2 long, items array<long>")
        found = found.where("n > 0").select(F.expr(_NODE).alias("node"), "items")
        return found.join(wanted, "node", "left_semi").groupBy("node").agg(F.any_value("items").alias("items"))

    ends_of = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = stored(sets_of(stored(ends_of(star := stored(star, "star")), "wanted")), "sets")
    tops = stored(components(stored(_verified(star, sets, percent), "links")), "components")
    tested = star

    def merged(found: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        """The whole sets and components once the links among ``found`` are known, and their number."""
        wanted = stored(ends_of(found).join(sets.select("node"), "node", "left_anti"), "wanted")
        more = sets.unionByName(stored(sets_of(wanted), "sets"))
        placed = stored(_verified(found, more, percent), "links")
        for end in ("a", "b"):  # links between components: fewer than those between classes
            placed = placed.join(tops.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left")
            placed = placed.withColumn(end, F.coalesce(f"c{end}", end)).drop(f"c{end}")
        roots = stored(components(placed.where("a != b").distinct()), "roots")
        old = tops.join(roots.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left")
        new = roots.join(tops, "node", "left_anti")
        return more, stored(old.select("node", F.coalesce("root", "component").alias("component")).unionByName(new), "components"), roots.count()

    def still_open(places: DataFrame) -> DataFrame:
        """``key, band, node, size, c`` of the buckets that hold several components c."""
        placed = places.join(tops, "node", "left").select("key", "band", "node", "size", F.coalesce("component", "node").alias("c"))
        several = placed.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 < c2").select("key")
        return placed.join(several, "key", "left_semi")

    places = met
    for number in range(MEETINGS):
        places = stored(still_open(places), "open")
        drawn = places.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(number)), "node", "c")).alias("d"))
        shared = places.join(drawn, "key").where("c != d.c").groupBy("node", F.lit(0).alias("side"), F.col("d.node").alias("end"))
        found = stored(nearest(shared.agg(F.count(F.lit(1)).alias("shared")), tested), "found")
        if found.isEmpty():
            break
        sets, tops, links = merged(found)
        tested = tested.unionByName(found)
        if not links:
            break
    for low, high in ((0, FIRST_BANDS), (FIRST_BANDS, bands)):
        rest = still_open(places.where(F.col("band").between(low, high - 1))).join(card, "node")
        blocks = F.ceil(F.col("size") / CROWD).cast("int")
        rest = rest.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("node", "size")
        rest = stored(rest, "open")
        mine = rest.select("key", "block", F.col("card").alias("x"), F.col("c").alias("cx"))
        other = rest.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("card").alias("y"), F.col("c").alias("cy"))
        meet = (F.col("x.node") < F.col("y.node")) & (F.col("cx") != F.col("cy")) & _alike("x", "y", percent, n, bits)
        across = mine.join(other, ["key", "block"]).where(meet).select(*_pairs("x", "y")).distinct()
        across = stored(across.join(tested, ["a", "b"], "left_anti"), "across")
        sets, tops, _ = merged(across)
        tested = tested.unionByName(across)

    placed = names.join(tops, "node", "left").select("node", "name", F.coalesce("component", "node").alias("g"))
    least = placed.groupBy("g").agg(F.min("name").alias("component_id"))
    found = placed.join(least, "g").select("node", "component_id")
    out = named.select("doc_id", F.col("n").alias("n_shingles"), "node").join(found, "node").drop("node")
    empty = signed.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = out.unionByName(empty)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
