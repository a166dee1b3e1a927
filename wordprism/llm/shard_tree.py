"""Sharding by a weighted hash tree: regions, racks, shards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Leaf = tuple[int, int, int, float]  # region, rack, shard, weight

RACK, REGION = 2, 4  # shards in a rack and in a region of the standard layout
BUCKETS = 4096  # ranges in which the rows of a shard are numbered side by side
_SCALE = 1 << 52


def layout(shards: int) -> list[Leaf]:
    """The standard layout: racks of two shards, regions of two racks, equal weights."""
    return [(s // REGION, s // RACK, s, 1.0) for s in range(shards)]


def _arrival(key: Column, shard: int, weight: float, seed: int) -> Column:
    """When the shard calls the key: exponential with the shard's weight as its rate."""
    draw = (F.pmod(F.xxhash64(F.lit(seed), F.lit(shard), key), F.lit(_SCALE)) + F.lit(0.5)) / F.lit(float(_SCALE))
    return -F.log(draw) / F.lit(float(weight))


def _first(calls: list[tuple[int, Column]]) -> Column:
    """Number of the earliest call; ties go to the smaller number."""
    least = F.least(*[c for _, c in calls]) if len(calls) > 1 else calls[0][1]
    return reduce(lambda rest, x: F.when(x[1] == least, F.lit(x[0])).otherwise(rest), reversed(calls[:-1]), F.lit(calls[-1][0]))


def _earliest(times: list[Column]) -> Column:
    return F.least(*times) if len(times) > 1 else times[0]


def assign(key: Column, leaves: list[Leaf], seed: int = 0) -> Column:
    """Shard of a key: descend from region to rack to shard.

    A subtree's draw is the earliest call of the shards in it, i.e. exponential with
    the sum of their weights, so each level is a weighted draw. A heavier or new
    shard changes only the draws of the subtrees above it: keys move into that
    shard and nowhere else, and a lighter one only gives keys away. Weights must be
    positive. A null key has one fixed place.
    """
    key = F.coalesce(key.cast("string"), F.lit("\u0000null"))
    time = {shard: _arrival(key, shard, weight, seed) for _, _, shard, weight in leaves if weight > 0}
    leaves = [x for x in leaves if x[3] > 0]
    if not leaves:
        raise ValueError("no shard has a positive weight")

    def under(level: int, node: int) -> list[Leaf]:
        return [x for x in leaves if x[level] == node]

    def child(level: int, candidates: list[Leaf]) -> list[tuple[int, Column]]:
        names = sorted({x[level] for x in candidates})
        return [(n, _earliest([time[x[2]] for x in candidates if x[level] == n])) for n in names]

    region = _first(child(0, leaves))
    regions, out = sorted({x[0] for x in leaves}), None
    for r in reversed(regions):
        rack, inner = _first(child(1, under(0, r))), None
        for k in sorted({x[1] for x in under(0, r)}, reverse=True):
            shard = _first(child(2, [x for x in under(0, r) if x[1] == k]))
            inner = shard if inner is None else F.when(rack == k, shard).otherwise(inner)
        out = inner if out is None else F.when(region == r, inner).otherwise(out)
    return out


def shard_documents(docs: DataFrame, shards: int = 8, leaves: list[Leaf] | None = None, seed: int = 0) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    The law is ``key``: doc_id and the layout decide. ``grown_shard`` is the shard
    with one more. Slots number the rows of a shard without gaps, in the order of
    buckets of doc_id, then doc_id, size and crc; rows that agree in all of these
    share consecutive slots. A first pass over doc_id alone counts each bucket, so
    no task numbers a whole shard.

    Null text: size 1, crc32 0. Null doc_id: one fixed shard, slots first in their
    bucket. Rows that repeat a doc_id go to one shard. No rows give no rows; other
    columns are ignored.
    """
    leaves = leaves or layout(shards)
    more = [*leaves, (shards // REGION, shards // RACK, shards, 1.0)]
    key = F.col("doc_id")
    bucket = F.pmod(F.xxhash64(F.lit("slot"), key), F.lit(BUCKETS)).cast("int")
    counts = (
        docs.select(assign(key, leaves, seed).alias("shard"), bucket.alias("_bucket"))
        .groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    )
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        key.alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), assign(key, leaves, seed).alias("shard"), assign(key, more, seed).alias("grown_shard"), bucket.alias("_bucket"),
    )
    order = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "size", "text_crc32")
    # at most shards * BUCKETS rows, so the offsets may be sent to every executor
    return (
        rows.withColumn("_row", F.row_number().over(order)).join(F.broadcast(offsets), ["shard", "_bucket"])
        .select("doc_id", "size", "text_crc32", "law", "shard", (F.col("_row") - 1 + F.col("_offset")).cast("long").alias("slot"), "grown_shard")
    )
