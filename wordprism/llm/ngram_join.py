"""N-gram Jaccard self-join: documents whose shingle sets nearly agree, and their groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordprism.llm import words as W
from wordprism.llm.components import components
from wordprism.plans.tables import stored

BUCKETS = 1 << 22  # counters of the frequency sketch: 16 MB, whatever the corpus
_PIECE = 1 << 14  # counters that travel in one row
PARTS = 32  # ranges of hash values whose sizes bound an overlap (the suffix filter)


def _sets(part: pa.RecordBatch, shingle: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    found = W.find(part.column("text"), W.NOT_SPACE, lower=True)
    grams = W.grams(found.hash, shingle)
    for begin, end in zip(found.row[:-1], found.row[1:]):
        if end - begin >= shingle:
            yield np.unique(grams[begin:end - shingle + 1])
        elif end > begin:
            yield W.grams(found.hash[begin:end], int(end - begin)) ^ np.uint64(end - begin)
        else:
            yield np.empty(0, np.uint64)


def _long(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def _sign(shingle: int):
    """Per document: size and fingerprint of its set. Per task: the frequency sketch, in pieces."""
    fields = pa.schema([
        ("doc_id", pa.int64()), ("n", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()),
        ("piece", pa.int32()), ("counts", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(BUCKETS, dtype=np.uint32)
        for batch in batches:
            for part in W.slices(batch):
                sets = list(_sets(part, shingle))
                if not sets:
                    continue
                everything = np.concatenate(sets)
                sketch += np.bincount((everything & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS).astype(np.uint32)
                with np.errstate(over="ignore"):
                    one = [s.sum(dtype=np.uint64) for s in sets]
                    two = [W.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets]
                none = pa.nulls(len(sets))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(_long(np.array(one, dtype=np.uint64))), pa.array(_long(np.array(two, dtype=np.uint64))),
                    none.cast(pa.int32()), none.cast(pa.binary()),
                ], schema=fields)
        if sketch.any():
            pieces = [(i, sketch[i * _PIECE:(i + 1) * _PIECE]) for i in range(BUCKETS // _PIECE)]
            pieces = [(i, (p.astype(np.uint8) if p.max() < 256 else p).tobytes()) for i, p in pieces if p.any()]
            none = pa.nulls(len(pieces), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, none, none, pa.array([i for i, _ in pieces], pa.int32()), pa.array([p for _, p in pieces], pa.binary())],
                schema=fields,
            )

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the pieces of one partition as they stream by."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            held = sums.setdefault(piece, np.zeros(_PIECE, dtype=np.uint64))
            small = len(counts.as_buffer()) == _PIECE
            held += np.frombuffer(counts.as_buffer(), dtype=np.uint8 if small else np.uint32)
    if sums:
        rows = [np.minimum(v, 2**32 - 1).astype(np.uint32).tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(rows, pa.binary())], names=["piece", "counts"])


def frequency_sketch(signed: DataFrame) -> np.ndarray:
    """How many documents hold a shingle of each bucket, over all documents; always BUCKETS numbers."""
    pieces = signed.where(F.col("piece").isNotNull()).select("piece", "counts")
    total = np.zeros(BUCKETS, dtype=np.uint32)
    for piece, counts in pieces.repartition(16, "piece").mapInArrow(_add, "piece int, counts binary").collect():
        total[piece * _PIECE:(piece + 1) * _PIECE] = np.frombuffer(counts, dtype=np.uint32)
    return total


def _prefixes(shingle: int, percent: int, sketch: np.ndarray):
    """Per document: its rarest shingles and the sizes of the hash ranges of its set."""
    fields = pa.schema([
        ("doc_id", pa.int64()), ("n", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()),
        ("prefix", pa.list_(pa.int64())), ("parts", pa.list_(pa.int32())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                rows = []
                for doc, values in zip(part.column("doc_id").to_pylist(), _sets(part, shingle)):
                    n = len(values)
                    if not n or doc is None:
                        continue
                    length = n - -(-percent * n // 100) + 1
                    rare = np.lexsort((values, sketch[(values & np.uint64(BUCKETS - 1)).astype(np.int64)]))[:length]
                    one, two = values.sum(dtype=np.uint64), W.mix(values ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                    sizes = np.bincount((values >> np.uint64(59)).astype(np.int64), minlength=PARTS)
                    rows.append((doc, n, int(_long(one[None])[0]), int(_long(two[None])[0]), _long(values[rare]), sizes.astype(np.int32)))
                if rows:
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, fields)], schema=fields)

    return run


def _full_sets(shingle: int):
    fields = pa.schema([("id", pa.int64()), ("items", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                sets = [_long(s) for s in _sets(part, shingle)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], schema=fields)

    return run


def _sets_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    return docs.join(wanted, "doc_id", "left_semi").mapInArrow(_full_sets(shingle), "id long, items array<long>")


def _overlap(percent: int, na: Column, nb: Column) -> Column:
    """Least number of common shingles of two sets that link."""
    return F.ceil(percent * (na + nb) / F.lit(100.0 + percent) - 1e-9)


def _filtered(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs whose hash ranges allow the overlap; each pair comes here once."""
    left = sizes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("parts").alias("pa"))
    right = sizes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("parts").alias("pb"))
    common = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.least(x, y)), F.lit(0), lambda total, x: total + x)
    return pairs.distinct().join(left, "a").join(right, "b").where(common >= _overlap(percent, F.col("na"), F.col("nb"))).select("a", "b").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose whole sets link."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("ia"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("ib"))
    both = F.size(F.array_intersect("ia", "ib"))
    union = F.size("ia") + F.size("ib") - both
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * union).select("a", "b").distinct()


def _near(percent: int, na: str, nb: str, pa: str, pb: str) -> Column:
    """Length and positional filter for two sets that meet at one of their prefix shingles.

    At the first shingle that two sets share in the common order, all they share lies
    from there on. A pair that fails there fails at its later shingles too, so it is
    enough that one of them passes.
    """
    na, nb, pa, pb = (F.col(c) for c in (na, nb, pa, pb))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (F.least(na - pa, nb - pb) >= _overlap(percent, na, nb))


def similar_groups(docs: DataFrame, shingle: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (doc_id, text; other columns are ignored).

    Two documents link when ``100 * |common shingles| >= percent * |union|``; a
    component is what links reach, named by its smallest doc_id. Texts are
    lower-cased (A-Z) and cut at white space.

    1. Equal sets become one class (its smallest doc_id stands for it).
    2. Shingles are ordered rare first by a sketch of document frequencies over
       all documents; a class is joined on its prefix only.
    3. Star pass: every class meets the smallest and the largest class on each of
       its prefix shingles. Length, positional and suffix filters, then one check
       of the whole sets. Large groups of near copies fall into components here
       with a number of pairs in proportion to their rows.
    4. Full pass: on shingles that still hold classes of different components, all
       pairs across components. Pairs inside a component need no check, since a
       link between them can't change it.

    Null or wordless texts: 0 shingles, a component of their own. Null doc_id: never
    a class's name; such a row takes the component of its class if that has a named
    row, else null. Repeated rows stay, rows that share a doc_id count as one
    document. No rows give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(
        docs.mapInArrow(_sign(shingle), "doc_id long, n long, fp1 long, fp2 long, piece int, counts binary"), "signatures"
    )
    sketch = frequency_sketch(signed)
    rows = signed.where(F.col("piece").isNull()).select("doc_id", "n", "fp1", "fp2")
    named = rows.where("n > 0")
    classes = stored(named.groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("id")), "classes")
    prefix_rows = docs.mapInArrow(
        _prefixes(shingle, percent, sketch), "doc_id long, n long, fp1 long, fp2 long, prefix array<long>, parts array<int>"
    )
    kept = classes.where(F.col("id").isNotNull()).withColumnRenamed("id", "doc_id")
    heads = stored(
        prefix_rows.join(kept, ["doc_id", "fp1", "fp2", "n"], "left_semi").dropDuplicates(["doc_id", "fp1", "fp2", "n"]), "prefixes"
    ).withColumnRenamed("doc_id", "id")
    sizes = heads.select("id", "n", "parts")
    places = heads.select("id", "n", F.posexplode("prefix").alias("pos", "shingle"))
    everyone = Window.partitionBy("shingle")
    met = places.withColumn("low", F.min("id").over(everyone)).withColumn("high", F.max("id").over(everyone))
    met = stored(met.where("low < high"), "meetings")
    ends = met.where("id = low or id = high").select("shingle", F.col("id").alias("end"), F.col("n").alias("n2"), F.col("pos").alias("pos2"))
    star = met.join(ends, "shingle").where((F.col("id") != F.col("end")) & _near(percent, "n", "n2", "pos", "pos2"))
    star = star.select(F.least("id", "end").alias("a"), F.greatest("id", "end").alias("b"))
    star = stored(_filtered(star, sizes, percent), "star")
    ids = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = stored(_sets_of(docs, stored(ids(star), "wanted"), shingle), "sets")
    links = stored(_verified(star, sets, percent), "links")
    first = stored(components(links), "components")
    placed = met.join(first.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component", "low", "high")
    open_shingles = placed.groupBy("shingle").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 < c2").select("shingle")
    rest = stored(placed.join(open_shingles, "shingle", "left_semi"), "open")
    other = rest.select("shingle", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("c").alias("cb"))
    mine = rest.select("shingle", F.col("id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("c").alias("ca"))
    on = (mine["shingle"] == other["shingle"]) & (mine["a"] < other["b"]) & (mine["ca"] != other["cb"]) & _near(percent, "na", "nb", "pa", "pb")
    full = mine.join(other, on).select("a", "b")
    full = stored(_filtered(full, sizes, percent), "across")
    known = sets.select(F.col("id").alias("doc_id")).distinct()
    wanted = stored(ids(full).join(known, "doc_id", "left_anti"), "wanted")
    more = stored(_verified(full, sets.unionByName(_sets_of(docs, wanted, shingle)), percent), "links")
    tops = first.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a != b")
    groups = components(tops.union(more)).withColumnRenamed("node", "id")
    found = classes.join(groups, "id", "left").select("fp1", "fp2", F.col("n").alias("_n"), F.coalesce("component", "id").alias("component_id"))
    full_rows = named.join(found, (named["fp1"] == found["fp1"]) & (named["fp2"] == found["fp2"]) & (named["n"] == found["_n"]), "left")
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full_rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(empty)
