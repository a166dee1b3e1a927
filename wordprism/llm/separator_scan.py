"""Token counts of documents in flat token files, by a scan for the end-of-document id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordprism.llm import token_ids as T
from wordprism.llm import words as W
from wordprism.session import scratch_path

END = 50256  # the vocabulary's end-of-document id, which no text yields when special strings are plain text
BLOCK_IDS = 1 << 18

_FLAT = "file int, block int, ids binary, first long, doc_ids array<bigint>"


def _flat(path: str, end: int, block_ids: int):
    """Blocks of two-byte ids that ignore where documents end; and, apart, the order of the documents."""
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64())]
    names = ["file", "block", "ids", "first", "doc_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file = T.encoder(path, True), TaskContext.get().partitionId()
        rest, block, docs = np.empty(0, np.uint16), 0, 0
        for batch in batches:
            for part in W.slices(batch):
                flat, count = encoder.encode(part.column("text"))
                rest = np.concatenate([rest, np.insert(flat, np.cumsum(count), end).astype("<u2")])
                rows = [(file, None, None, docs, part.column("doc_id").to_pylist())]
                docs += part.num_rows
                for at in range(0, len(rest) - block_ids + 1, block_ids):
                    rows.append((file, block, rest[at:at + block_ids].tobytes(), None, None))
                    block += 1
                rest = rest[len(rest) // block_ids * block_ids:]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        if len(rest):
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((file, block, rest.tobytes(), None, None), kinds)], names=names)

    return run


def write_flat(docs: DataFrame, path: str | None = None, end: int = END, block_ids: int = BLOCK_IDS, to: str | None = None) -> str:
    """Write ``docs`` (doc_id, text) as flat token files, one per task, with ``end`` after each document.

    Rows with ``ids`` are blocks of a fixed number of ids; they say nothing about
    documents. Rows with ``doc_ids`` list the documents of a file in order.
    """
    path, to = path or T.vocabulary_path(), to or scratch_path(docs.sparkSession, "token-flat")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows.mapInArrow(_flat(path, end, block_ids), _FLAT).write.option("compression", "zstd").parquet(to)
    return to


def _separators(end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for ids in batch.column("ids"):
                block = np.frombuffer(ids.as_buffer(), "<u2") if ids.is_valid else np.empty(0, np.uint16)
                sizes.append(len(block))
                found.append(np.flatnonzero(block == end).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32()))],
                names=["file", "block", "n", "ends"],
            )

    return run


def scan(blocks: DataFrame, end: int = END) -> DataFrame:
    """``file, ordinal, start, n_tokens, terminated`` of every document in flat blocks (file, block, ids).

    Each block is searched for the end id as one array. What a block needs from the
    blocks before it is a prefix scan over one row per block: ids so far, documents
    so far, and where the last end was, so a document may span any number of blocks.

    ``n_tokens`` leaves out the end id, ``start`` counts ids in the file. Two ends in
    a row make an empty document; ids after the last end make one more document,
    with ``terminated`` false. Null blocks are empty. No blocks: no rows.
    """
    found = blocks.select("file", "block", "ids").mapInArrow(_separators(end), "file int, block int, n long, ends array<int>")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    found = found.withColumn("last", F.when(F.size("ends") > 0, F.col("before") + F.element_at("ends", -1)))
    found = found.withColumn("open", F.coalesce(F.max("last").over(earlier) + 1, F.lit(0)))
    found = found.withColumn("docs", F.coalesce(F.sum(F.size("ends")).over(earlier), F.lit(0)))
    position = F.col("before") + F.col("e")
    document = found.select("file", "before", "open", "docs", "ends", F.posexplode("ends").alias("i", "e")).select(
        "file", (F.col("docs") + F.col("i")).alias("ordinal"),
        F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("before") + F.get("ends", F.col("i") - 1) + 1).alias("start"), position.alias("stop"),
    )
    whole = document.select("file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), F.lit(True).alias("terminated"))
    per_file = found.groupBy("file").agg(F.sum("n").alias("n"), F.coalesce(F.max("last") + 1, F.lit(0)).alias("start"), F.sum(F.size("ends")).alias("ordinal"))
    tail = per_file.where("n > start").select("file", "ordinal", "start", (F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("terminated"))
    return whole.unionByName(tail)


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, terminated`` of all ``docs``: written as flat files, then scanned.

    Null or empty texts count 0. Null ids and repeated rows stay. No rows: no rows.
    """
    stored = docs.sparkSession.read.schema(_FLAT).parquet(write_flat(docs, path))
    counts = scan(stored.where("ids is not null"))
    names = stored.where("doc_ids is not null").select("file", "first", F.posexplode("doc_ids").alias("i", "doc_id"))
    names = names.select("file", (F.col("first") + F.col("i")).alias("ordinal"), "doc_id")
    return counts.join(names, ["file", "ordinal"]).select("doc_id", "n_tokens", "terminated")
