"""Token ids of whole texts, by a public tokenizer and a cache of text chunks.

Byte-level BPE merges inside pre-tokens only, and a pre-token never crosses from a
visible character into the space before the next one. Texts are therefore cut at
such spaces; the library encodes each distinct chunk once per cache, and ids of
whole texts are gathered from the cache.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from wordprism.llm import words as W

VOCABULARY = "byte_bpe_50k.json"
CACHE_CHUNKS = 1_500_000  # chunks a worker remembers; a full cache is emptied
_MEAN = 64  # chunks of more ids are not remembered
_PIECES = 20_000  # short pre-tokens a worker remembers


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def library(path: str, plain_specials: bool):
    """The tokenizer; ``plain_specials`` treats special strings in a text as ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = plain_specials
    return tokenizer


@lru_cache(maxsize=1)
def _pretokens():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN).findall


def _shown() -> dict[int, int]:
    """Byte -> character by which a byte-level vocabulary writes it."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}


_SHOWN = _shown()

# a byte after which, or before which, a space surely separates two pre-tokens: visible ASCII,
# or part of a two-byte character other than U+0080-U+00BF (that range and longer characters hold white space)
_VISIBLE = np.zeros(256, dtype=bool)
_VISIBLE[0x21:0x7F] = True
_TWO = np.zeros(256, dtype=bool)
_TWO[0xC3:0xE0] = True
_NEXT = _VISIBLE | _TWO
_NEXT[[0xE0, *range(0xE4, 0xF5)]] = True


def chunk_starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Byte positions at which chunks start: texts, and spaces between visible characters."""
    cut = np.zeros(len(data), dtype=bool)
    if len(data) > 2:
        before = _VISIBLE[data[:-2]]
        before[1:] |= _TWO[data[:-3]]
        cut[1:-1] = (data[1:-1] == 0x20) & before & _NEXT[data[2:]]
    cut[texts[:-1][texts[:-1] < len(data)]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Encodes batches of texts; holds the chunk cache as sorted arrays."""

    def __init__(self, path: str, plain_specials: bool = False, cache_chunks: int = CACHE_CHUNKS):
        self.path, self.plain, self.limit = path, plain_specials, cache_chunks
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.begin, self.count = np.empty(0, np.int64), np.empty(0, np.int32)
        self.ids = np.empty(0, np.uint32)
        self.pieces: dict[str, list[int]] = {}

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks. Pre-tokens go straight to the library's model; special strings take its whole way."""
        tokenizer = library(self.path, self.plain)
        model, split, known = tokenizer.model, _pretokens(), self.pieces
        flat: list[int] = []
        sizes = np.empty(len(chunks), dtype=np.int32)
        for i, chunk in enumerate(chunks):
            before = len(flat)
            if "<|" in chunk:
                flat += tokenizer.encode(chunk, add_special_tokens=False).ids
            else:
                for piece in split(chunk):
                    ids = known.get(piece)
                    if ids is None:
                        ids = [t.id for t in model.tokenize(piece.encode().decode("latin-1").translate(_SHOWN))]
                        if len(known) < _PIECES and len(piece) < 8:
                            known[piece] = ids
                    flat += ids
            sizes[i] = len(flat) - before
        return np.array(flat, dtype=np.uint32), sizes

    def _learn(self, keys: np.ndarray, flat: np.ndarray, count: np.ndarray) -> None:
        if len(self.keys) + len(keys) > self.limit:
            self.clear()
        begin = np.cumsum(count, dtype=np.int64) - count + len(self.ids)
        self.ids = np.concatenate([self.ids, flat])
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.begin = np.insert(self.begin, place, begin)
        self.count = np.insert(self.count, place, count)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each text."""
        data, at = W.text_bytes(texts)
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        start = chunk_starts(data, at)
        end = np.append(start[1:], len(data))
        up, down = W._powers(max(W.SLICE_BYTES + 1, len(data) + 1))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(W._VALUES[False][data] * up[:len(data)], out=sums[1:])
        hashed = W.mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
        keys, first, inverse = np.unique(hashed, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), dtype=bool)
        fresh = np.flatnonzero(~known)
        begin, count = np.empty(len(keys), np.int64), np.empty(len(keys), np.int32)
        pool = self.ids
        if known.any():
            begin[known], count[known] = self.begin[place[known]], self.count[place[known]]
        if len(fresh):
            raw = data.tobytes()
            chunks = [raw[a:b].decode("utf-8") for a, b in zip(start[first[fresh]].tolist(), end[first[fresh]].tolist())]
            flat, sizes = self._encode(chunks)
            begin[fresh], count[fresh] = np.cumsum(sizes, dtype=np.int64) - sizes + len(pool), sizes
            pool = np.concatenate([pool, flat])
            short = sizes <= _MEAN
            offsets = np.cumsum(sizes, dtype=np.int64) - sizes
            self._learn(keys[fresh[short]], flat[W.ragged(offsets[short], sizes[short])], sizes[short])
        per_chunk = count[inverse].astype(np.int64)
        ids = pool[W.ragged(begin[inverse], per_chunk)]
        upto = np.concatenate([[0], np.cumsum(per_chunk)])
        borders = upto[np.searchsorted(start, at)]
        return ids, np.diff(borders)


@lru_cache(maxsize=4)
def encoder(path: str, plain_specials: bool = False, cache_chunks: int = CACHE_CHUNKS) -> Encoder:
    """The encoder of this worker, with its cache."""
    return Encoder(path, plain_specials, cache_chunks)
