"""Adaptive context-mixing range coder for token ids, many blocks side by side.

Every block starts from nothing and ends in its own checksum. Blocks are coded in
step with each other: one array operation treats the same position of all blocks,
for coding and decoding alike, so both sides pass through the same model states.

The model of a block, at each id:
* order 2 and order 1 each guess one id from the last two or the last one, with a
  confidence that grows with hits;
* the confidences and whether the guesses agree choose an adaptive pair of
  probabilities, which mixes the orders: guess of order 2, guess of order 1, neither;
* in the last case order 0 codes the id from counts of the ids of the block so far,
  taken anew each time their number doubles, with an escape to 16 plain bits.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 4096  # ids of a block
_TOP = np.uint64(32)
_ONE = np.uint64(1)
_LOW = np.uint64(0xFFFFFFFF)
_BITS2, _BITS1 = 12, 11  # sizes of the guess tables
_SLOTS, _SLOT_BITS = 1 << 14, 14  # resolution of order 0
_FIRST = 128  # ids before order 0 has counts
_MIN, _MAX, _RATE = 64, 65408, 4  # bounds and rate of the mixing probabilities
_NONE = 65535
_GOAL0, _GOAL1 = np.array([_MAX, _MIN, _MIN], np.int64), np.array([_MIN, _MAX, _MIN], np.int64)
_SURER, _LESS = np.array([1] * 7 + [0], np.int32), np.array([x - (x >> 1) for x in range(8)], np.int32)
_HEAD = struct.Struct("<4sII I")  # mark, ids, crc32 of the ids (as 32-bit little-endian), words
_MARK = b"CMX1"


class _Guesses:
    """Tables of the order-1 and order-2 guesses and the mixing probabilities of all blocks.

    A guess and its confidence (0 to 7) share one number, so do the two probabilities of a context.
    """

    def __init__(self, lanes: int):
        self.at2 = np.arange(lanes, dtype=np.int64) << _BITS2
        self.at1 = np.arange(lanes, dtype=np.int64) << _BITS1
        self.table2, self.table1 = np.zeros(lanes << _BITS2, np.int32), np.zeros(lanes << _BITS1, np.int32)
        self.base = np.arange(lanes, dtype=np.int64) << 7
        self.mix = np.full(lanes << 7, (1 << 30) + (1 << 14), dtype=np.int64)
        self.last = np.zeros(lanes, np.int64)
        self.older = np.zeros(lanes, np.int64)

    def look(self, n: int) -> tuple:
        """The guesses of the first n blocks and the two borders of the 16-bit scale."""
        last = self.last[:n]
        hashed = last * 40503 + self.older[:n] * 10007
        i2 = self.at2[:n] + ((hashed ^ (hashed >> _BITS2)) & ((1 << _BITS2) - 1))
        i1 = self.at1[:n] + ((last ^ (last >> _BITS1) * 5) & ((1 << _BITS1) - 1))
        e2, e1 = self.table2.take(i2), self.table1.take(i1)
        g2, g1 = e2 >> 3, e1 >> 3
        context = self.base[:n] + (((e2 & 7) << 4) | ((e1 & 7) << 1) | (g2 == g1))
        p = self.mix.take(context)
        p0 = p >> 16
        border = p0 + np.maximum((65536 - p0) * (p & 65535) >> 16, 1)
        return g2, g1, p0, border, i2, i1, e2, e1, context, p

    def learn(self, n: int, looked: tuple, ids: np.ndarray, event: np.ndarray) -> None:
        _, g1, p0, _, i2, i1, e2, e1, context, p = looked
        hit = event == 0
        p1 = p & 65535
        step = (_GOAL1.take(event) - p1) >> _RATE
        step[hit] = 0
        self.mix[context] = ((p0 + ((_GOAL0.take(event) - p0) >> _RATE)) << 16) + p1 + step
        fresh = ids << 3
        for table, at, old, right in ((self.table2, i2, e2, hit), (self.table1, i1, e1, g1 == ids)):
            sure = old & 7
            table[at] = np.where(right, old + _SURER.take(sure), np.where(sure < 2, fresh, old - _LESS.take(sure)))
        self.older[:n] = self.last[:n]
        self.last[:n] = ids


class _Counts:
    """Order 0 of all blocks: shares of the ids seen so far, fixed until the next ``take``."""

    def __init__(self) -> None:
        self.ids = None

    def take(self, history: np.ndarray) -> None:
        lanes, seen = history.shape
        rows = np.sort(history, axis=1)
        fresh = np.ones(rows.shape, dtype=bool)
        fresh[:, 1:] = rows[:, 1:] != rows[:, :-1]
        at = np.flatnonzero(fresh.ravel())
        lane = at // seen
        count = np.diff(np.append(at, rows.size))
        self.kinds = np.bincount(lane, minlength=lanes)
        escape = np.minimum(np.maximum(self.kinds // 2, 64), _SLOTS // 4)
        room = _SLOTS - escape - self.kinds
        self.ids = rows.ravel()[at]
        self.lane = lane
        self.share = 1 + count * room[lane] // seen
        self.begin = np.cumsum(self.kinds) - self.kinds
        total = np.cumsum(self.share)
        first = total[self.begin] - self.share[self.begin]
        self.below = total - self.share - first[lane]
        self.used = np.bincount(lane, self.share, lanes).astype(np.int64)


class _Writer:
    def __init__(self, lanes: int, length: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
        self.words, self.at = np.zeros((lanes, length * 3 // 2 + 8), np.uint32), np.zeros(lanes, np.int64)

    def put(self, who: np.ndarray | slice, below: np.ndarray, share: np.ndarray, bits: int) -> None:
        unit = self.range[who] >> np.uint64(bits)
        add = unit * below.view(np.uint64)
        low = self.low[who] + add
        over = np.flatnonzero(low < add)
        if len(over):
            self._carry(over if isinstance(who, slice) else who[over])
        size = unit * share.view(np.uint64)
        out = np.flatnonzero(size < _ONE << _TOP)
        if len(out):
            lanes = out if isinstance(who, slice) else who[out]
            self.words[lanes, self.at[lanes]] = low[out] >> _TOP
            self.at[lanes] += 1
            low[out] <<= _TOP
            size[out] <<= _TOP
        self.low[who], self.range[who] = low, size

    def _carry(self, lanes: np.ndarray) -> None:
        at = self.at[lanes] - 1
        while len(lanes):
            self.words[lanes, at] += np.uint32(1)
            more = self.words[lanes, at] == 0
            lanes, at = lanes[more], at[more] - 1

    def end(self) -> None:
        lanes = np.arange(len(self.at))
        self.words[lanes, self.at] = self.low >> _TOP
        self.words[lanes, self.at + 1] = self.low & _LOW
        self.at += 2


class _Reader:
    def __init__(self, words: np.ndarray):
        self.words = words
        lanes = len(words)
        self.code = (words[:, 0].astype(np.uint64) << _TOP) | words[:, 1]
        self.range, self.at = np.full(lanes, 2**64 - 1, np.uint64), np.full(lanes, 2, np.int64)

    def take(self, who: np.ndarray | slice, unit: np.ndarray, below: np.ndarray, share: np.ndarray) -> None:
        code = self.code[who] - unit * below.view(np.uint64)
        size = unit * share.view(np.uint64)
        more = np.flatnonzero(size < _ONE << _TOP)
        if len(more):
            lanes = more if isinstance(who, slice) else who[more]
            at = np.minimum(self.at[lanes], self.words.shape[1] - 1)  # a damaged block may ask for more than it has
            code[more] = (code[more] << _TOP) | self.words[lanes, at]
            self.at[lanes] += 1
            size[more] <<= _TOP
        self.code[who], self.range[who] = code, size


def _interval(event: np.ndarray, p0: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where an event begins on the 16-bit scale, and how wide it is."""
    below = np.where(event == 0, 0, np.where(event == 1, p0, border))
    return below, np.where(event == 0, p0, np.where(event == 1, border, 65536)) - below


def _stops(length: int) -> list[int]:
    """Positions at which order 0 takes its counts."""
    out, at = [], _FIRST
    while at < length:
        out.append(at)
        at *= 2
    return out


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """One self-contained byte string per block of at most BLOCK ids below 65,536."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    sizes = np.array([len(blocks[i]) for i in order])
    lanes, length = len(order), int(sizes[0]) if len(order) else 0
    ids = np.zeros((lanes, max(length, 1)), np.uint16)
    for row, i in enumerate(order):
        ids[row, :len(blocks[i])] = blocks[i]
    guesses, counts, writer = _Guesses(lanes), _Counts(), _Writer(lanes, length)
    columns = np.ascontiguousarray(ids.T).astype(np.int32)
    place, stops = None, set(_stops(length))
    for t in range(length):
        n = int(np.searchsorted(-sizes, -t, side="left"))  # blocks that are longer than t
        if t in stops:
            counts.take(ids[:n, :t])
            if place is None:
                place = np.full((lanes, 65536), _NONE, np.uint16)
            place[counts.lane, counts.ids] = np.arange(len(counts.ids)) - counts.begin[counts.lane]
        now = columns[t, :n]
        looked = guesses.look(n)
        g2, g1, p0, border = looked[:4]
        event = np.where(now == g2, 0, np.where(now == g1, 1, 2))
        writer.put(slice(0, n), *_interval(event, p0, border), 16)
        rest = np.flatnonzero(event == 2)
        if len(rest):
            wanted = now[rest]
            if counts.ids is not None:
                there = place[rest, wanted]
                known = there != _NONE
                flat = counts.begin[rest] + np.where(known, there, 0)
                below = np.where(known, counts.below[flat], counts.used[rest])
                share = np.where(known, counts.share[flat], _SLOTS - counts.used[rest])
                writer.put(rest, below, share, _SLOT_BITS)
                rest, wanted = rest[~known], wanted[~known]
            if len(rest):
                writer.put(rest, wanted.astype(np.int64), np.ones(len(rest), np.int64), 16)
        guesses.learn(n, looked, now, event)
    writer.end()
    out: list[bytes] = [b""] * lanes
    for row, i in enumerate(order):
        crc = zlib.crc32(ids[row, :sizes[row]].astype("<u4").tobytes())
        words = writer.words[row, :writer.at[row]].astype("<u4").tobytes()
        out[i] = _HEAD.pack(_MARK, int(sizes[row]), crc, len(words) // 4) + words
    return out


def block_size(data: bytes | memoryview, at: int = 0) -> int:
    """Bytes of the block that starts at ``at``."""
    return _HEAD.size + 4 * _HEAD.unpack_from(data, at)[3]


def decode(blocks: list[bytes | memoryview]) -> list[np.ndarray]:
    """The ids of each block; raises ValueError where a checksum does not hold."""
    heads = [_HEAD.unpack_from(b) for b in blocks]
    if any(h[0] != _MARK for h in heads):
        raise ValueError("not a block of token ids")
    order = sorted(range(len(blocks)), key=lambda i: -heads[i][1])
    sizes = np.array([heads[i][1] for i in order])
    lanes, length = len(order), int(sizes[0]) if len(order) else 0
    words = np.zeros((lanes, max([h[3] for h in heads], default=0) + 4), np.uint32)
    for row, i in enumerate(order):
        words[row, :heads[i][3]] = np.frombuffer(blocks[i], "<u4", heads[i][3], _HEAD.size)
    guesses, counts, reader = _Guesses(lanes), _Counts(), _Reader(words)
    ids, stops, slots = np.zeros((lanes, max(length, 1)), np.uint16), set(_stops(length)), None
    columns = np.zeros((max(length, 1), lanes), np.uint16)
    for t in range(length):
        n = int(np.searchsorted(-sizes, -t, side="left"))
        if t in stops:
            counts.take(columns[:t, :n].T.copy())
            escape = np.full(n, -1, np.int64)
            value = np.empty(len(counts.ids) + n, np.int64)
            times = np.empty(len(value), np.int64)
            spot = np.arange(len(counts.ids)) + counts.lane
            last = np.cumsum(counts.kinds) + np.arange(n)
            value[spot], times[spot] = np.arange(len(counts.ids)), counts.share
            value[last], times[last] = escape, _SLOTS - counts.used
            slots = np.repeat(value, times).astype(np.int32)
        looked = guesses.look(n)
        g2, g1, p0, border = looked[:4]
        every = slice(0, n)
        unit = reader.range[every] >> np.uint64(16)
        code = reader.code[every]
        event = (code >= unit * p0.view(np.uint64)).astype(np.int64) + (code >= unit * border.view(np.uint64))
        reader.take(every, unit, *_interval(event, p0, border))
        now = np.where(event == 0, g2, g1)
        rest = np.flatnonzero(event == 2)
        if len(rest):
            if counts.ids is not None:
                unit = reader.range[rest] >> np.uint64(_SLOT_BITS)
                slot = np.minimum(reader.code[rest] // unit, np.uint64(_SLOTS - 1)).astype(np.int64)
                flat = slots[(rest << _SLOT_BITS) + slot]
                known = flat >= 0
                there = np.maximum(flat, 0)
                below = np.where(known, counts.below[there], counts.used[rest])
                share = np.where(known, counts.share[there], _SLOTS - counts.used[rest])
                reader.take(rest, unit, below, share)
                now[rest] = counts.ids[there]
                rest = rest[~known]
            if len(rest):
                unit = reader.range[rest] >> np.uint64(16)
                plain = np.minimum(reader.code[rest] // unit, np.uint64(65535)).astype(np.int64)
                reader.take(rest, unit, plain, np.ones(len(rest), np.int64))
                now[rest] = plain
        columns[t, :n] = now
        guesses.learn(n, looked, now, event)
    out: list[np.ndarray] = [np.empty(0, np.uint32)] * lanes
    ids = columns.T
    for row, i in enumerate(order):
        out[i] = ids[row, :sizes[row]].astype(np.uint32)
        if zlib.crc32(out[i].astype("<u4").tobytes()) != heads[i][2]:
            raise ValueError("checksum of a block of token ids differs")
    return out
