"""Importance resampling: draw documents so that their word n-grams look like a target's.

n-grams are hashed by the CRC-32 of their bytes. A text's words, joined by single
spaces, are scanned once for the running CRC at every word border. The CRC of any
n-gram follows from the two at its ends: a CRC is linear over GF(2), so the part
before the n-gram, moved on by the n-gram's length, cancels out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordprism.llm import words as W
from wordprism.plans.ranking import with_global_rank
from wordprism.plans.tables import stored

BUCKETS = 10_000
LONGEST = 2  # words of the longest feature
SCALE = 1000  # of gains and of the noise
LEAST_WORDS = 20  # shorter documents are never drawn
PERCENT = 25
SEED = 7
_LANE = 1024  # bytes that one lane of the scan walks through
_ONES = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    """CRC-32 register after one byte (reflected polynomial 0xEDB88320)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_TABLE = _byte_table()


def _move_tables(bits: int = 40) -> np.ndarray:
    """``[k, byte number, byte]``: the share of a register's byte once 2**k zero bytes have followed."""
    one = np.uint32(1) << np.arange(32, dtype=np.uint32)
    columns = _TABLE[one & np.uint32(255)] ^ (one >> np.uint32(8))
    out = np.zeros((bits, 4, 256), dtype=np.uint32)
    for k in range(bits):
        for part in range(4):
            for bit in range(8):
                has = (np.arange(256) >> bit) & 1 == 1
                out[k, part, has] ^= columns[8 * part + bit]
        columns = _step(out[k], columns)
    return out


def _step(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    byte = np.uint32(255)
    return table[0][crc & byte] ^ table[1][(crc >> np.uint32(8)) & byte] ^ table[2][(crc >> np.uint32(16)) & byte] ^ table[3][crc >> np.uint32(24)]


_MOVES = _move_tables()


def moved(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of prefixes as they stand ``length`` bytes later; one table step per binary digit of the length."""
    out = crc.copy()
    for k in range(int(length.max()).bit_length() if len(length) else 0):
        at = np.flatnonzero((length >> k) & 1)
        out[at] = _step(_MOVES[k], out[at])
    return out


def running_crcs(data: np.ndarray) -> np.ndarray:
    """``zlib.crc32(data[:i])`` for every i from 0 to len(data).

    The bytes are cut into lanes that are walked in step; each lane starts from the
    CRC of all lanes before it.
    """
    n = len(data)
    if not n:
        return np.zeros(1, np.uint32)
    lanes = -(-n // _LANE)
    padded = np.zeros(lanes * _LANE, dtype=np.uint8)
    padded[:n] = data
    begin = np.zeros(lanes, dtype=np.uint32)
    for lane in range(1, lanes):
        begin[lane] = zlib.crc32(padded[(lane - 1) * _LANE:lane * _LANE], int(begin[lane - 1]))
    steps = np.ascontiguousarray(padded.reshape(lanes, _LANE).T)
    walked = np.empty((_LANE, lanes), dtype=np.uint32)
    state = begin ^ _ONES
    for i in range(_LANE):
        state = _TABLE[(state ^ steps[i]) & np.uint32(255)] ^ (state >> np.uint32(8))
        walked[i] = state
    out = np.empty(n + 1, dtype=np.uint32)
    out[0] = 0
    out[1:] = walked.T.reshape(-1)[:n] ^ _ONES
    return out


def feature_crcs(texts: pa.Array, longest: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words per text, and for each length up to ``longest`` the CRCs of all n-grams, text by text."""
    found = W.find(texts, W.ALNUM, lower=True, hashed=False)
    data, start, end = W.joined(found, W.ALNUM)
    running = running_crcs(data)
    before, after, doc = running[start], running[end], found.doc()
    out = []
    for n in range(1, longest + 1):
        last = np.arange(n - 1, len(start))
        last = last[doc[last] == doc[last - n + 1]] if len(last) else last
        first = last - n + 1
        out.append(after[last] ^ moved(before[first], end[last] - start[first]))
    return np.diff(found.row), out


def _count(buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in W.slices(batch):
                for crcs in feature_crcs(part.column("text"), longest)[1]:
                    total += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    return run


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """``bucket, n``: features of all texts in each bucket that has any."""
    counted = docs.select("text").mapInArrow(_count(buckets, longest), "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, scale: int = SCALE) -> np.ndarray:
    """Per bucket floor(scale * ln of the smoothed ratio of the target's share to the documents' share).

    Always ``buckets`` numbers, whatever the corpus.
    """
    counts = []
    for rows in (docs, target):
        held = np.zeros(buckets, dtype=np.int64)
        for bucket, n in bucket_counts(rows, buckets, longest).collect():
            held[bucket] = n
        counts.append(held.tolist())
    (source, wanted), (s_all, t_all) = counts, (sum(counts[0]), sum(counts[1]))
    ratio = (((t + 1) * (s_all + buckets)) / ((s + 1) * (t_all + buckets)) for s, t in zip(source, wanted))
    return np.array([math.floor(scale * math.log(x)) for x in ratio], dtype=np.int64)


def _weigh(gain: np.ndarray, longest: int):
    buckets = np.uint32(len(gain))
    names = ["doc_id", "n_words", "n_features", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                n_words, features = feature_crcs(part.column("text"), longest)
                total, size = np.zeros(len(n_words), np.int64), np.zeros(len(n_words), np.int64)
                for n, crcs in enumerate(features, 1):
                    each = np.maximum(n_words - n + 1, 0)
                    sums = np.concatenate([[0], np.cumsum(gain[crcs % buckets])])
                    border = np.concatenate([[0], np.cumsum(each)])
                    total += sums[border[1:]] - sums[border[:-1]]
                    size += each
                weight = np.where(size > 0, total // np.maximum(size, 1), 0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c.astype(np.int64)) for c in (n_words, size, weight))], names=names)

    return run


def noise(doc_id: Column, seed: int = SEED, scale: int = SCALE) -> Column:
    """floor(scale * Gumbel draw) that depends on the seed and the id only; a missing id is ``null``."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(float(-scale)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def importance(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for every row of ``docs`` (doc_id, text; other columns are ignored).

    ``target`` needs a column ``text``. Features are all runs of 1 to ``longest`` words, repeats counted;
    a document's weight is the floored mean of its features' gains, its score the
    weight plus the noise. Of the N rows with at least ``least_words`` words the
    floor(percent * N / 100) highest scores are drawn and numbered from 1.

    Null or wordless texts: no features, weight 0, never drawn. Null doc_id: scored
    with the id ``null``, last among ties. Equal scores go to the smaller doc_id;
    rows that repeat an id follow by features and weight, and equal rows each count.
    An empty target or no documents: all counts are 0 and gains are still defined; no rows give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gain = gains(docs, target, buckets, longest)
    rows = docs.mapInArrow(_weigh(gain, longest), "doc_id long, n_words long, n_features long, weight long")
    rows = stored(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weights")
    wide = rows.where(F.col("n_words") >= least_words)
    drawn = percent * wide.count() // 100
    keys = ["_down", "_none", "doc_id", "n_features", "weight", "_row"]
    wide = wide.withColumn("_down", -F.col("score")).withColumn("_none", F.col("doc_id").isNull()).withColumn("_row", F.monotonically_increasing_id())
    ranked = with_global_rank(wide, keys, "_at").withColumn("rank", F.when(F.col("_at") < drawn, F.col("_at") + 1))
    rest = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*names).unionByName(rest.select(*names))


def resample(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The drawn documents, with the columns of ``docs``.

    Rows are found again by their id; where rows share an id, all of them come if
    one of them was drawn. A drawn row without an id brings no row.
    """
    drawn = importance(docs, target, **settings).where(F.col("rank").isNotNull()).select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(drawn, docs["doc_id"].cast("long") == F.col("_drawn"), "left_semi")
