"""Token files in tables that Spark writes: coded segments with a document table, and flat runs of ids without one."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordprism.llm import token_coder as C
from wordprism.llm import token_ids as T
from wordprism.llm import words as W
from wordprism.session import scratch_path

SEGMENT_IDS = 1 << 20  # ids after which a segment is closed; a document is never cut
BATCH_IDS = 2 << 20  # ids that are coded or decoded at once
END_ID = 0
_MARK = b"SEG1"
_HEAD = struct.Struct("<4sI")

_SEGMENT = "file int, segment int, n_docs long, n_ids long, payload binary"


def _pack(docs: list[int | None], sizes: np.ndarray, blocks: list[bytes]) -> bytes:
    null = np.array([d is None for d in docs], dtype=np.uint8)
    ids = np.array([d or 0 for d in docs], dtype="<i8")
    return b"".join([_HEAD.pack(_MARK, len(docs)), ids.tobytes(), null.tobytes(), sizes.astype("<i8").tobytes(), *blocks])


def _unpack(payload: memoryview) -> tuple[list[int | None], np.ndarray, list[memoryview]]:
    mark, n = _HEAD.unpack_from(payload)
    if mark != _MARK:
        raise ValueError("not a segment of token ids")
    at = _HEAD.size
    docs, null = np.frombuffer(payload, "<i8", n, at), np.frombuffer(payload, np.uint8, n, at + 8 * n)
    sizes = np.frombuffer(payload, "<i8", n, at + 9 * n)
    at, blocks = at + 17 * n, []
    while at < len(payload):
        step = C.block_size(payload, at)
        blocks.append(payload[at:at + step])
        at += step
    return [None if x else int(d) for d, x in zip(docs, null)], sizes, blocks


def _coded(path: str, end_id: int, batch_ids: int, cache_chunks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.release()
        encoder, file = T.encoder(path, cache_chunks=cache_chunks), TaskContext.get().partitionId()
        number, waiting, held = 0, [], 0  # closed segments that wait for coding
        docs: list[int | None] = []
        sizes: list[int] = []
        ids: list[np.ndarray] = []
        size = 0

        def close() -> None:
            nonlocal number, size, docs, sizes, ids, held
            flat = np.concatenate(ids)
            waiting.append((number, docs, np.array(sizes, np.int64), flat))
            held += len(flat)
            number, size, docs, sizes, ids = number + 1, 0, [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal held, waiting
            parts = [[f[i:i + C.BLOCK] for i in range(0, len(f), C.BLOCK)] for _, _, _, f in waiting]
            coded = C.encode([b for p in parts for b in p])
            rows, at = [], 0
            for (n, d, s, f), part in zip(waiting, parts):
                rows.append((file, n, len(d), len(f), _pack(d, s, coded[at:at + len(part)])))
                at += len(part)
            waiting, held = [], 0
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["file", "segment", "n_docs", "n_ids", "payload"])

        for batch in batches:
            for part in W.slices(batch):
                flat, count = encoder.encode(part.column("text"))
                upto = np.cumsum(count)
                whole = np.insert(flat, upto, end_id)  # the end id of each document
                borders = np.concatenate([[0], upto + np.arange(1, len(upto) + 1)])
                names, first = part.column("doc_id").to_pylist(), 0
                while first < len(names):
                    last = max(first + 1, int(np.searchsorted(borders, borders[first] + SEGMENT_IDS - size, side="right")) - 1)
                    docs += names[first:last]
                    sizes += np.diff(borders[first:last + 1]).tolist()
                    ids.append(whole[borders[first]:borders[last]].astype(np.uint16))
                    size += int(borders[last] - borders[first])
                    first = last
                    if size >= SEGMENT_IDS or first < len(names):
                        close()
                        if held >= batch_ids:
                            yield flush()
        if docs:
            close()
        if waiting:
            yield flush()

    return run


def write_coded(docs: DataFrame, path: str | None = None, end_id: int = END_ID, to: str | None = None, batch_ids: int = BATCH_IDS, cache_chunks: int = T.CACHE_CHUNKS) -> str:
    """Write ``docs`` (doc_id, text) as coded segments in ascending doc_id order; returns the folder.

    Rows are range partitioned by doc_id (null first, rows that repeat an id by a
    hash of the text and the text), one partition is one file. Each segment holds
    its documents' ids and lengths and a run of independent blocks. The vocabulary
    must have fewer than 65,536 ids.
    """
    path, to = path or T.vocabulary_path(), to or scratch_path(docs.sparkSession, "token-segments")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_tag"))
    rows = rows.repartitionByRange("doc_id", "_tag").sortWithinPartitions("doc_id", "_tag", "text").select("doc_id", "text")
    rows.mapInArrow(_coded(path, end_id, batch_ids, cache_chunks), _SEGMENT).write.parquet(to)
    return to


def _decoded(batch_ids: int):
    def out(held: list[tuple]) -> pa.RecordBatch:
        plain = C.decode([b for h in held for b in h[4]])
        columns: list[list] = [[] for _ in range(7)]
        at = 0
        for file, segment, docs, sizes, blocks in held:
            ids = np.concatenate(plain[at:at + len(blocks)]).astype("<u4")
            at += len(blocks)
            ends = np.cumsum(sizes)
            starts = ends - sizes
            for values, new in zip(columns, (
                [file] * len(docs), [segment] * len(docs), range(len(docs)), docs, starts.tolist(), sizes.tolist(),
                [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())],
            )):
                values += new
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "segment", "place", "doc_id", "start", "n_tokens", "ids_crc32"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.release()
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for file, segment, n_ids, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                held.append((file, segment, *_unpack(memoryview(payload.as_buffer()))))
                size += n_ids
                if size >= batch_ids:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    return run


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, segment, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            docs, sizes, blocks = _unpack(memoryview(payload.as_buffer()))
            flat = np.concatenate(C.decode(blocks)).astype(np.int32)
            lists = np.split(flat, np.cumsum(sizes)[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([file] * len(docs), pa.int32()), pa.array([segment] * len(docs), pa.int32()), pa.array(range(len(docs)), pa.int64()), pa.array(docs, pa.int64()), pa.array(lists, pa.list_(pa.int32()))],
                names=["file", "segment", "place", "doc_id", "ids"],
            )


def read_ids(segments: DataFrame) -> DataFrame:
    """``file, segment, place, doc_id, ids`` of every document; raises where a checksum doesn't hold."""
    return segments.select("file", "segment", "payload").mapInArrow(_ids, "file int, segment int, place long, doc_id long, ids array<int>")


def read_index(segments: DataFrame, batch_ids: int = BATCH_IDS) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the decoded segments.

    ``start`` counts the ids of all documents before it: running sums over the
    segments of a file and over the files, one row each.
    """
    rows = segments.select("file", "segment", "n_ids", "payload").mapInArrow(
        _decoded(batch_ids), "file int, segment int, place long, doc_id long, start long, n_tokens long, ids_crc32 long"
    )
    sizes = segments.select("file", "segment", "n_ids")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    files = sizes.groupBy("file").agg(F.sum("n_ids").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start"))
    offsets = sizes.select("file", "segment", F.coalesce(F.sum("n_ids").over(inner), F.lit(0)).alias("inner_start")).join(files, "file")
    return rows.join(offsets, ["file", "segment"]).select(
        "doc_id", (F.col("start") + F.col("inner_start") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def encode_documents(
    docs: DataFrame, path: str | None = None, end_id: int = END_ID, batch_ids: int = BATCH_IDS, cache_chunks: int = T.CACHE_CHUNKS,
) -> DataFrame:
    """Write all ``docs`` as coded segments, read them back: ``doc_id, start, n_tokens, ids_crc32``.

    Ids come from the tokenizers library (its special strings in a text are
    special tokens), ``end_id`` closes each document. Null text: the end id alone.
    Null doc_id: first. Repeated rows: one document each. No rows: no rows. Other
    columns are ignored. ``batch_ids`` are coded in step and ``cache_chunks`` pieces of text
    remembered: more take more memory and less time; the result does not depend on them.
    """
    to = write_coded(docs, path, end_id, batch_ids=batch_ids, cache_chunks=cache_chunks)
    return read_index(docs.sparkSession.read.schema(_SEGMENT).parquet(to), batch_ids)
