"""Substring deduplication with one compressed FM-index per shard of passages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordprism.llm import words as W

WINDOW = 13
ANCHOR = 5  # words of an anchor
SHARD_WORDS = 400_000  # words of the passages of one index
_NO = np.int64(np.iinfo(np.int64).max)
_SPANS = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("first", pa.int64()), ("end", pa.int64())])


def _limit(shard_words: int) -> int:
    """Bytes of the passages of one index, about as many as its words take."""
    return shard_words * 6


class Bits:
    """A packed bit vector with the number of ones before each word of 64 bits."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded.reshape(-1, 64), axis=1, bitorder="little").view("<u8").ravel()
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(ones) - ones).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletTree:
    """Symbols as one bit vector per level, each level sorted by the bits above it."""

    def __init__(self, symbols: np.ndarray, kinds: int):
        self.depth = max(1, int(kinds - 1).bit_length())
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(self.depth - 1, -1, -1):
            bit = (symbols >> shift) & 1
            zeros = int(len(bit) - bit.sum())
            self.levels.append((shift, Bits(bit.astype(np.uint8)), zeros))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position ``at``."""
        begin = np.zeros(len(at), dtype=np.int64)
        at = at.astype(np.int64)
        for shift, bits, zeros in self.levels:
            one = (symbol >> shift) & 1 == 1
            both = bits.rank(np.concatenate([begin, at]))
            ones_begin, ones_at = both[:len(at)], both[len(at):]
            begin = np.where(one, zeros + ones_begin, begin - ones_begin)
            at = np.where(one, zeros + ones_at, at - ones_at)
        return at - begin


class Index:
    """FM-index of passages over word numbers; 0 separates passages.

    Suffixes are sorted by at least ``depth`` words, which is enough for backward
    search of patterns up to that length.
    """

    def __init__(self, text: np.ndarray, kinds: int, owner: np.ndarray, depth: int = WINDOW):
        n = len(text)
        rank, step = text.astype(np.int64), 1
        while step < depth:
            after = np.zeros(n, dtype=np.int64)
            after[:n - step] = rank[step:] + 1
            _, rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + after, return_inverse=True)
            step *= 2
        order = np.argsort(rank, kind="stable")
        self.owner = owner[order]
        self.tree = WaveletTree(text[order - 1], kinds)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=kinds))])

    def least_owner(self, patterns: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Smallest owner of the occurrences of each pattern (rows of equal length).

        Backward search for all patterns in step, from the last word to the first. A
        pattern leaves the search when its interval is empty, or, where the pattern is
        one of this text's own (``own``), when only that one occurrence is left.
        """
        alone = own.astype(np.int64)
        count, length = patterns.shape
        low, high = self.first[patterns[:, -1]].copy(), self.first[patterns[:, -1] + 1].copy()
        active = np.flatnonzero(high - low > alone)
        out = np.full(count, _NO)
        for t in range(length - 2, -1, -1):
            word = patterns[active, t]
            both = self.tree.rank(np.concatenate([word, word]), np.concatenate([low[active], high[active]]))
            base = self.first[word]
            low[active], high[active] = base + both[:len(active)], base + both[len(active):]
            active = active[high[active] - low[active] > alone[active]]
            if not len(active):
                break
        if len(active):  # the intervals of different patterns don't overlap
            begin, which = np.unique(low[active], return_inverse=True)
            end = np.zeros(len(begin), dtype=np.int64)
            end[which] = high[active]
            edges = np.stack([begin, end], axis=1).ravel()
            padded = np.append(self.owner, _NO)
            out[active] = np.minimum.reduceat(padded, edges)[::2][which]
        return out


def anchors(found: W.Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: text number, first and last window (as word numbers), anchor hash.

    The anchor of a window is the smallest hash of the ``anchor``-word grams in it, so
    equal windows have equal anchors wherever they stand.
    """
    none = np.empty(0, np.int64)
    grams = W.grams(found.hash, anchor)
    span = window - anchor + 1
    n = len(found.hash) - window + 1
    if n <= 0:
        return none, none, none, np.empty(0, np.uint64)
    least, width = grams, 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[:len(least) - step], least[step:])
        width += step
    text = found.doc()
    inside = np.flatnonzero(text[:n] == text[window - 1:])
    if not len(inside):
        return none, none, none, np.empty(0, np.uint64)
    value, owner = least[inside], text[inside]
    fresh = np.ones(len(inside), dtype=bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(fresh)
    last = inside[np.append(at[1:], len(inside)) - 1]
    return owner[at], inside[at], last, value[at]


def _anchor_rows(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                found = W.find(part.column("text"))
                text, first, last, value = anchors(found, window, anchor)
                order = np.lexsort((value, text))
                text, first, last, value = text[order], first[order], last[order], value[order]
                fresh = np.ones(len(text), dtype=bool)
                fresh[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
                at = np.flatnonzero(fresh)
                size = np.add.reduceat(found.end[last + window - 1] - found.start[first], at) if len(at) else at
                docs = part.column("doc_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value[at].view(np.int64)), pa.array(docs[text[at]], pa.int64()), pa.array(size, pa.int64())],
                    names=["anchor", "doc_id", "size"],
                )

    return run


def _among(values: np.ndarray, text: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Which values (sorted by their text number) are in the list of their text."""
    keep = np.zeros(len(values), dtype=bool)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if not len(flat):
        return keep
    begin = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    starts = np.searchsorted(text, np.arange(len(lists) + 1))
    for i in np.flatnonzero(np.diff(begin)):
        a, b = starts[i], starts[i + 1]
        keep[a:b] = np.isin(values[a:b], flat[begin[i]:begin[i + 1]])
    return keep


def _passages(window: int, anchor: int):
    """What each text has around the anchors that other documents have too.

    Anchors that fit an index (``anchors``): one row per passage, ``part`` null, the
    passage as ``data``. Anchors that don't (``hot``): one row per different window of
    the text, ``part`` its hash, the word numbers where it starts as ``data`` (int32).
    """
    fields = pa.schema([
        ("anchor", pa.int64()), ("part", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("first", pa.int64()), ("data", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("anchors").is_valid())
            for part in W.slices(batch):
                found = W.find(part.column("text"))
                text, first, last, value = anchors(found, window, anchor)
                signed = value.view(np.int64)
                docs, tags = part.column("doc_id").to_numpy(zero_copy_only=False), part.column("tag").to_numpy(zero_copy_only=False)
                keep = _among(signed, text, part.column("anchors"))
                t, begin, end = text[keep], first[keep], last[keep]
                data = found.data.tobytes()
                passages = [data[a:b] for a, b in zip(found.start[begin].tolist(), found.end[end + window - 1].tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(signed[keep]), pa.nulls(len(t), pa.int64()), pa.array(docs[t], pa.int64()), pa.array(tags[t], pa.int64()),
                    pa.array(begin - found.row[t]), pa.array(passages, pa.binary()),
                ], schema=fields)
                keep = _among(signed, text, part.column("hot"))
                if not keep.any():
                    continue
                count = last[keep] - first[keep] + 1
                at = W.ragged(first[keep], count)
                t, key = np.repeat(text[keep], count), np.repeat(signed[keep], count)
                name = W.grams(found.hash, window)[at].view(np.int64)
                order = np.lexsort((at, name, key, t))
                at, t, key, name = at[order], t[order], key[order], name[order]
                fresh = np.ones(len(at), dtype=bool)
                fresh[1:] = (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (name[1:] != name[:-1])
                head = np.flatnonzero(fresh)
                place = (at - found.row[t]).astype("<i4")
                offsets = np.append(head, len(at)).astype(np.int32) * np.int32(4)
                places = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(offsets), pa.py_buffer(place)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(key[head]), pa.array(name[head]), pa.array(docs[t[head]], pa.int64()), pa.array(tags[t[head]], pa.int64()),
                    pa.array(place[head].astype(np.int64)), places,
                ], schema=fields)

    return run


def _covered(docs: np.ndarray, passages: pa.Array, window: int, shard_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, first and end word (in the passage) of runs of windows that start in a smaller document."""
    kinds = passages.dictionary_encode()
    content = kinds.indices.to_numpy(zero_copy_only=False)
    least = np.full(len(kinds.dictionary), _NO)
    np.minimum.at(least, content, docs)
    found = W.find(kinds.dictionary.cast(pa.large_binary()).view(pa.large_string()))
    names, word = np.unique(found.hash, return_inverse=True)
    size = np.diff(found.row)
    windows = size - window + 1
    at = W.ragged(found.row[:-1], windows)  # first word of each window
    patterns = word[at[:, None] + np.arange(window)] + 1
    earliest = np.repeat(least, windows)
    source = np.repeat(np.arange(len(size)), windows)
    # passages beyond one index's bound are split over several; each pattern meets all of them
    cuts = np.unique(np.searchsorted(found.row, np.arange(0, found.row[-1] + shard_words, shard_words)))
    cuts[-1] = len(size)
    for a, b in zip(cuts[:-1], cuts[1:]):
        many = size[a:b] + 1
        text = np.zeros(int(many.sum()), dtype=np.int64)
        ends = np.cumsum(many) - 1
        inside = np.ones(len(text), dtype=bool)
        inside[ends] = False
        text[inside] = word[found.row[a]:found.row[b]] + 1
        index = Index(text, len(names) + 1, np.repeat(least[a:b], many), window)
        earliest = np.minimum(earliest, index.least_owner(patterns, (source >= a) & (source < b)))
    first = np.cumsum(windows) - windows
    count = windows[content]
    row = np.repeat(np.arange(len(docs)), count)
    place = W.ragged(np.zeros(len(docs), np.int64), count)
    hit = earliest[W.ragged(first[content], count)] < docs[row]
    row, place = row[hit], place[hit]
    if not len(row):
        return row, place, place
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
    begin = np.flatnonzero(fresh)
    last = np.append(begin[1:], len(row)) - 1
    return row[begin], place[begin], place[last] + window


def _later(batch: pa.RecordBatch, before: tuple | None, window: int) -> tuple[pa.RecordBatch, tuple]:
    """Spans of windows that a smaller document has; rows are sorted by anchor, part, doc_id.

    ``before`` is the anchor, part and smallest document of the last row of the batch before.
    """
    anchor, name, docs, tags = (batch.column(c).to_numpy() for c in ("anchor", "part", "doc_id", "tag"))
    fresh = np.ones(len(docs), dtype=bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (name[1:] != name[:-1])
    head = np.flatnonzero(fresh)
    least = docs[head].copy()
    if before is not None and (anchor[0], name[0]) == before[:2]:
        least[0] = before[2]
    hit = np.flatnonzero(docs > np.repeat(least, np.diff(np.append(head, len(docs)))))
    data = batch.column("data").take(pa.array(hit))
    count = pc.binary_length(data).to_numpy(zero_copy_only=False) // 4
    place = np.frombuffer(b"".join(data.to_pylist()), dtype="<i4").astype(np.int64)
    row = np.repeat(hit, count)
    return pa.RecordBatch.from_arrays(
        [pa.array(docs[row]), pa.array(tags[row]), pa.array(place), pa.array(place + window)], schema=_SPANS
    ), (anchor[-1], name[-1], least[-1])


def _shards(window: int, shard_words: int):
    """Cut a stream that is sorted by anchor into shards, index each and search it.

    Windows of hot anchors are compared as they stream by; nothing of them is held.
    """
    limit = _limit(shard_words)

    def search(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        docs, tags, first = (table.column(c).to_numpy() for c in ("doc_id", "tag", "first"))
        passages = table.column("data")
        passages = passages.chunk(0) if isinstance(passages, pa.ChunkedArray) else passages
        row, begin, end = _covered(docs, passages, window, shard_words)
        return pa.RecordBatch.from_arrays([pa.array(docs[row]), pa.array(tags[row]), pa.array(first[row] + begin), pa.array(first[row] + end)], schema=_SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last, before = 0, None, None
        for batch in batches:
            windows = batch.filter(batch.column("part").is_valid())
            if windows.num_rows:
                spans, before = _later(windows, before, window)
                yield spans
            batch = batch.filter(batch.column("part").is_null())
            anchor = batch.column("anchor").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else []
            upto = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column("data")).to_numpy(zero_copy_only=False))]) if len(anchor) else [0]
            begin = 0
            for edge in edges:
                if (edge or anchor[0] != last) and size + int(upto[edge] - upto[begin]) >= limit:
                    held.append(batch.slice(begin, edge - begin))
                    yield search(pa.Table.from_batches(held))
                    held, size, begin = [], 0, int(edge)
            if batch.num_rows:
                held.append(batch.slice(begin))
                size += int(upto[-1] - upto[begin])
                last = anchor[-1]
        if held:
            yield search(pa.Table.from_batches(held))

    return run


def _dealt(docs: DataFrame, window: int, anchor: int, shard_words: int) -> DataFrame:
    """The passages and windows of ``repeated_spans``, dealt and sorted for the shards."""
    named = docs.where("doc_id is not null").select("doc_id", "text")
    rows = named.mapInArrow(_anchor_rows(window, anchor), "anchor long, doc_id long, size long")
    same = Window.partitionBy("anchor")
    near = rows.withColumn("least", F.min("doc_id").over(same)).withColumn("most", F.max("doc_id").over(same)).withColumn("total", F.sum("size").over(same))
    fits = F.col("total") <= _limit(shard_words)
    shared = near.where("least < most").groupBy("doc_id").agg(
        F.collect_set(F.when(fits, F.col("anchor"))).alias("anchors"), F.collect_set(F.when(~fits, F.col("anchor"))).alias("hot")
    )
    marked = docs.join(shared, "doc_id", "left").select("doc_id", "text", "tag", "anchors", "hot")
    schema = "anchor long, part long, doc_id long, tag long, first long, data binary"
    passages = marked.mapInArrow(_passages(window, anchor), schema)
    return passages.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "doc_id")


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``doc_id, tag, first, end``: word spans covered by windows that start in a smaller doc_id; spans may overlap.

    ``docs`` has doc_id, text, tag (any number that tells rows with one doc_id apart).

    1. Each run of windows with the same anchor makes one row (anchor, doc_id); an
       anchor that two documents have is shared.
    2. Shared anchors go back to their documents, which send the passages around
       them to the anchor's shard. Equal windows have equal anchors, so a window
       meets all its copies there.
    3. A shard indexes its distinct passages (with their smallest document) and
       searches every window of every passage.
    4. An anchor whose passages together exceed an index is hot. Its windows are dealt
       one by one by their own hash, sorted by document, and compared with the first
       of their kind as they stream by. So no task holds more than two indexes' worth of
       passages, and the work on a hot anchor is linear in its windows.
    """
    return _dealt(docs, window, anchor, shard_words).mapInArrow(_shards(window, shard_words), "doc_id long, tag long, first long, end long")


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.slices(batch):
            found = W.find(part.column("text"), hashed=False)
            data = found.data.tobytes()
            removed, digests, texts = [], [], []
            spans, tags = part.column("spans"), part.column("tag").to_numpy(zero_copy_only=False)
            flat = spans.flatten()
            of = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False))
            tag, first, end = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("tag", "first", "end"))
            own = tag == tags[of]
            of, first, end = of[own], first[own], end[own]
            change = np.zeros(int(found.row[-1]) + 1, dtype=np.int64)
            np.add.at(change, found.row[of] + first, 1)
            np.add.at(change, found.row[of] + end, -1)
            gone = np.cumsum(change[:-1]) > 0
            for a, b in zip(found.row[:-1].tolist(), found.row[1:].tolist()):
                keep = np.flatnonzero(~gone[a:b]) + a
                kept = b" ".join([data[x:y] for x, y in zip(found.start[keep].tolist(), found.end[keep].tolist())])
                removed.append(int(gone[a:b].sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode("utf-8"))
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array(np.diff(found.row), pa.int64()), pa.array(removed, pa.int64()),
                pa.array(digests, pa.string()), pa.array(texts, pa.string()),
            ], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def dedup_substrings(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept`` for every row of ``docs`` (doc_id, text).

    Words are runs of characters other than white space. Each word covered by a
    window of ``window`` words that also starts in a document with a smaller
    doc_id is removed; windows are judged on the input.

    Null text has no words. A null doc_id is neither smaller nor larger than any
    other: its row keeps all words and removes none elsewhere. Rows that share a
    doc_id don't remove each other's words. Texts shorter than a window stay whole.
    No rows: no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tag", F.xxhash64("text"))
    spans = repeated_spans(rows, window, anchor, shard_words).groupBy("doc_id").agg(F.collect_list(F.struct("tag", "first", "end")).alias("spans"))
    joined = rows.join(spans, "doc_id", "left").select("doc_id", "text", "tag", "spans")
    return joined.mapInArrow(_finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
