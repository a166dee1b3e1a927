"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from wordprism.llm import words as W

WINDOW = 10
SHARD_WORDS = 1_000_000  # words of the items of one automaton; more items make more automata
COVERAGE = 0.8  # a document hit beyond this part of its words is removed whole
_SEED = 3


class Automaton:
    """All substrings of the items, over 64-bit word hashes.

    ``follow[s]`` maps a word to the next state, ``link[s]`` is the longest proper
    suffix in another state, ``size[s]`` the length of the longest string of ``s``.
    ``held[s]`` is the set of items in which a string of ``s`` occurs, kept for
    states that can hold a window.
    """

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        self.follow: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.held: list[set[str]] = [set()]
        self.short: dict[tuple[int, ...], set[str]] = {}
        ends: list[tuple[int, str]] = []
        grams, shortest = [], window
        for name, words in items:
            if not words:
                continue
            if len(words) < window:
                self.short.setdefault(tuple(words), set()).add(name)
                shortest = min(shortest, len(words))
            last = 0
            for word in words:
                last = self._extend(last, word)
                ends.append((last, name))
        self.lengths = sorted({len(w) for w in self.short})
        for state, name in ends:
            self.held[state].add(name)
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            up = self.link[state]
            if up > 0 and self.size[up] >= window:
                self.held[up] |= self.held[state]
        self.shortest = shortest
        self.seed = min(_SEED, shortest)
        for _, words in items:
            grams.append(W.grams(np.array(words, dtype=np.uint64), self.seed))
        self.grams = np.unique(np.concatenate(grams)) if grams else np.empty(0, np.uint64)

    def _new(self, size: int, follow: dict[int, int], link: int) -> int:
        self.size.append(size)
        self.follow.append(follow)
        self.link.append(link)
        self.held.append(set())
        return len(self.size) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """State for ``word`` after ``state`` that holds no longer strings; splits ``target`` if it does."""
        if self.size[state] + 1 == self.size[target]:
            return target
        clone = self._new(self.size[state] + 1, dict(self.follow[target]), self.link[target])
        self.link[target] = clone
        while state >= 0 and self.follow[state].get(word) == target:
            self.follow[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, word: int) -> int:
        there = self.follow[last].get(word)
        if there is not None:
            return self._split(last, word, there)
        new, state = self._new(self.size[last] + 1, {}, 0), last
        while state >= 0 and word not in self.follow[state]:
            self.follow[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word, self.follow[state][word])
        return new

    def lengths_of(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """State and longest matching length after each word."""
        state = size = 0
        for word in words:
            while state and word not in self.follow[state]:
                state = self.link[state]
                size = self.size[state]
            there = self.follow[state].get(word)
            state, size = (there, size + 1) if there is not None else (0, 0)
            yield state, size

    def windows(self, words: list[int]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurrence of a window, and the items of these windows."""
        hit, items = np.zeros(len(words) + 1, dtype=np.int64), set()
        for at, (state, size) in enumerate(self.lengths_of(words)):
            if size >= self.window:
                while self.size[self.link[state]] >= self.window:  # the state of the last ``window`` words
                    state = self.link[state]
                items |= self.held[state]
                hit[at + 1 - self.window] += 1
                hit[at + 1] -= 1
            for length in self.lengths:
                if length <= size and (names := self.short.get(tuple(words[at + 1 - length:at + 1]))):
                    items |= names
                    hit[at + 1 - length] += 1
                    hit[at + 1] -= 1
        return np.cumsum(hit)[:-1] > 0, items

    def runs(self, hashes: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of words that can hold a window: the first ``seed`` steps of the automaton, for all words at once.

        Every window is a row of overlapping seeds that are all strings of the
        automaton, so a stretch without enough of them in a row is passed over.
        """
        grams = W.grams(hashes, self.seed)
        if not len(grams) or not len(self.grams):
            return []
        place = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        known = np.concatenate([[False], self.grams[place] == grams, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        begin, end = edges[::2], edges[1::2]
        long = end - begin >= self.shortest - self.seed + 1
        return [(int(b), int(e) + self.seed - 1) for b, e in zip(begin[long], end[long])]


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.slices(batch):
            found = W.find(part.column("text"), W.ALNUM, lower=True)
            values = found.hash.view(np.int64)
            lists = [values[a:b] for a, b in zip(found.row[:-1], found.row[1:])]
            yield pa.RecordBatch.from_arrays([part.column("item_id"), pa.array(lists, pa.list_(pa.int64()))], names=["item_id", "words"])


def item_words(benchmark: DataFrame) -> DataFrame:
    """``item_id`` (as a string, or null) and the word hashes of each item; items without words are left out."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return rows.mapInArrow(_items, "item_id string, words array<long>").where(F.size("words") > 0)


def automata(benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> Iterator[Automaton]:
    """Automata over groups of items, each of at most ``shard_words`` words or one item, built as items stream in."""
    held: list[tuple[str | None, list[int]]] = []
    total = 0
    for row in item_words(benchmark).toLocalIterator():
        if held and total + len(row.words) > shard_words:
            yield Automaton(held, window)
            held, total = [], 0
        held.append((row.item_id, [w & 0xFFFFFFFFFFFFFFFF for w in row.words]))
        total += len(row.words)
    if held:
        yield Automaton(held, window)


def hits(found: W.Words, automaton: Automaton) -> dict[int, tuple[np.ndarray, set[str]]]:
    """Text number -> (its hit words as a mask, items), for texts with a window."""
    out: dict[int, tuple[np.ndarray, set[str]]] = {}
    starts = found.row
    for begin, end in automaton.runs(found.hash):
        first = int(np.searchsorted(starts, begin, side="right")) - 1
        last = int(np.searchsorted(starts, end - 1, side="right")) - 1
        for text in range(first, last + 1):  # a stretch may run over the border of two texts
            a, b = max(begin, int(starts[text])), min(end, int(starts[text + 1]))
            mask, items = automaton.windows(found.hash[a:b].tolist())
            if items:
                whole, names = out.setdefault(text, (np.zeros(int(starts[text + 1] - starts[text]), dtype=bool), set()))
                whole[a - int(starts[text]):b - int(starts[text])] |= mask
                names |= items
    return out


def _scan(held: list[Automaton]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                found = W.find(part.column("text"), W.ALNUM, lower=True)
                count = part.num_rows
                n_hit, n_items, names, spans = np.zeros(count, np.int64), np.zeros(count, np.int64), [[] for _ in range(count)], [[] for _ in range(count)]
                merged: dict[int, tuple[np.ndarray, set[str]]] = {}
                for automaton in held:
                    for text, (mask, items) in hits(found, automaton).items():
                        if text in merged:
                            merged[text] = (merged[text][0] | mask, merged[text][1] | items)
                        else:
                            merged[text] = (mask, items)
                for text, (mask, items) in merged.items():
                    n_hit[text], n_items[text], names[text] = int(mask.sum()), len(items), sorted(items - {None})
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                    spans[text] = [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]
                digest = [hashlib.sha256(",".join(n).encode()).hexdigest() for n in names]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(np.diff(found.row), pa.int64()), pa.array(n_hit), pa.array(n_items),
                    pa.array(digest), pa.array(n_hit > 0), pa.array(names, pa.list_(pa.string())),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"])

    return run


_REPORT = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "items array<string>, spans array<struct<start: bigint, end: bigint>>"
)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per row of ``docs``: words, hit words, items found, and the hit spans (in words, end exclusive).

    Texts are lower-cased (A-Z) and cut into runs of letters, digits and non-ASCII
    characters. A window is ``window`` consecutive words of an item, or a whole
    shorter item. Documents are streamed through the automaton without a shuffle;
    an automaton is bounded by ``shard_words``, and every document meets each.

    Null or wordless texts have no words and no hits. Null ids stay. Items that
    repeat a text are all reported, an item_id that repeats counts once; items without
    an id hit and are cut like others, count as one in n_items together and have no
    name in items and the digest. Items without words are left out. No items: nothing is hit. No rows: no rows.
    Other columns are ignored.
    """
    held = list(automata(benchmark, window, shard_words))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(held), _REPORT)


def _clean(held: list[Automaton], coverage: float, fields: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                found = W.find(part.column("text"), W.ALNUM, lower=True)
                cut: dict[int, np.ndarray] = {}
                for automaton in held:
                    for text, (mask, _) in hits(found, automaton).items():
                        cut[text] = cut[text] | mask if text in cut else mask
                texts, keep = part.column("text").to_pylist() if cut else None, np.ones(part.num_rows, dtype=bool)
                for text, mask in cut.items():
                    if mask.mean() > coverage:
                        keep[text] = False
                        continue
                    begin, stop = int(found.text[text]), int(found.text[text + 1])
                    first = int(found.row[text])
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                    at, left = begin, []
                    for a, b in zip(edges[::2], edges[1::2]):
                        left.append(found.data[at:found.start[first + a]].tobytes())
                        at = int(found.end[first + b - 1])
                    left.append(found.data[at:stop].tobytes())
                    texts[text] = b"".join(left).decode("utf-8")
                columns = {name: part.column(name) for name in part.schema.names}
                if cut:
                    columns["text"] = pa.array(texts, fields.field("text").type)
                    if "n_chars" in columns:
                        changed = columns["n_chars"].to_pylist()
                        for text in cut:
                            changed[text] = len(texts[text])
                        columns["n_chars"] = pa.array(changed, fields.field("n_chars").type)
                out = pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in fields], schema=fields)
                yield out if keep.all() else out.filter(pa.array(keep))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the hit spans; a text hit beyond ``coverage`` of its words goes whole.

    All columns stay; ``n_chars``, if there is one, follows a changed text.
    """
    held = list(automata(benchmark, window))
    return docs.mapInArrow(_clean(held, coverage, to_arrow_schema(docs.schema)), docs.schema)
