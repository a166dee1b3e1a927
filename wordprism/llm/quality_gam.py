"""Quality classifier: a generalised additive model with pairwise interactions on whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordprism.llm import words as W

TRAIN_ROWS = 20_000  # labelled rows of the fit, those of the smallest hash
BINS = 64
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.1
PAIRS, PAIR_BINS = 6, 8
THRESHOLD = 0.3
_EPSILON = 1e-9

FEATURES = (
    "log_words", "log_bytes", "mean_word", "sd_word", "longest_word", "long_words", "short_words", "distinct_words", "top_word",
    "repeats_last", "distinct_triples", "upper", "digit", "punctuation", "symbol", "exclamation", "bar", "non_ascii", "control",
    "newlines", "words_per_line", "sentence_ends", "capital_words", "all_caps_words", "words_with_symbol",
)


def _per_text(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between borders."""
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[borders[1:]] - sums[borders[:-1]]


_IS = {name: np.zeros(256, dtype=np.float32) for name in ("upper", "digit", "punctuation", "symbol", "exclamation", "bar", "non_ascii", "control", "newlines")}
_IS["upper"][65:91] = 1
_IS["digit"][48:58] = 1
_IS["punctuation"][[ord(c) for c in ".,;:?'\"()-"]] = 1
_IS["symbol"][[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = 1
_IS["exclamation"][ord("!")] = 1
_IS["bar"][ord("|")] = 1
_IS["non_ascii"][128:] = 1
_IS["control"][[*range(9), *range(14, 32), 127]] = 1
_IS["newlines"][10] = 1
_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ".?!"]] = True


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text; an empty or null text gives zeros."""
    found = W.find(texts)
    n, words = len(found.row) - 1, np.diff(found.row).astype(float)
    size = np.diff(found.text).astype(float)
    some, bytes_ = np.maximum(words, 1), np.maximum(size, 1)
    length = (found.end - found.start).astype(float)
    total = _per_text(length, found.row)
    mean = total / some
    variance = np.maximum(_per_text(length**2, found.row) / some - mean**2, 0)
    counts = {name: _per_text(mask[found.data], found.text) / bytes_ for name, mask in _IS.items()}
    longest, distinct, top, triples = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    grams = W.grams(found.hash, 3)
    for i, (a, b) in enumerate(zip(found.row[:-1].tolist(), found.row[1:].tolist())):
        if b > a:
            runs = np.sort(found.hash[a:b])
            edges = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1], [True]]))
            longest[i], distinct[i], top[i] = length[a:b].max(), (len(edges) - 1) / (b - a), np.diff(edges).max() / (b - a)
            if b - a > 2:
                part = np.sort(grams[a:b - 2])
                triples[i] = (1 + np.count_nonzero(part[1:] != part[:-1])) / (b - a - 2)
    same = np.zeros(len(found.hash))
    if len(same):
        same[1:] = found.hash[1:] == found.hash[:-1]
        same[found.row[:-1][found.row[:-1] < len(same)]] = 0
    if len(length):
        first, last = found.data[found.start], found.data[found.end - 1]
        upper = _IS["upper"][found.data]
        marks = (_IS["symbol"] + _IS["exclamation"] + _IS["bar"])[found.data]
        spans = np.concatenate([[0.0], np.cumsum(upper, dtype=np.float64)])
        odd = np.concatenate([[0.0], np.cumsum(marks, dtype=np.float64)])
        capital = _IS["upper"][first]
        caps = (spans[found.end] - spans[found.start] >= 0.8 * length) & (length > 1)
        symbols, ends = odd[found.end] > odd[found.start], _END[last]
    else:
        capital = caps = symbols = ends = np.empty(0)
    share = lambda values: _per_text(values, found.row) / some
    lines = counts["newlines"] * bytes_ + 1
    columns = {
        "log_words": np.log1p(words), "log_bytes": np.log1p(size), "mean_word": mean, "sd_word": np.sqrt(variance), "longest_word": longest,
        "long_words": share(length > 12), "short_words": share(length < 3), "distinct_words": distinct, "top_word": top,
        "repeats_last": share(same), "distinct_triples": triples, "words_per_line": words / lines, "sentence_ends": share(ends),
        "capital_words": share(capital), "all_caps_words": share(caps), "words_with_symbol": share(symbols), **counts,
    }
    return np.stack([columns[name] for name in FEATURES], axis=1)


@dataclass
class Model:
    """``cuts[j]`` are the bin borders of a feature, ``tables[j]`` what each bin adds to the log odds."""

    start: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: a sum of table entries for all rows at once."""
        odds = np.full(len(x), self.start)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            odds += table[np.searchsorted(cuts, x[:, j], side="right")]
        for a, b, cuts_a, cuts_b, table in self.pairs:
            odds += table[np.searchsorted(cuts_a, x[:, a], side="right"), np.searchsorted(cuts_b, x[:, b], side="right")]
        return 1.0 / (1.0 + np.exp(-np.clip(odds, -35, 35)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The split of a row of bins that gains most, as (gain, first bin of the right side)."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """A shallow tree over the bins of one feature, as the value of each bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        found = [(*_best_cut(g[a:b], h[a:b]), i) for i, (a, b) in enumerate(parts)]
        gain, at, i = max(found)
        if gain <= _EPSILON:
            break
        a, b = parts[i]
        parts[i:i + 1] = [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree that splits one feature and then the other on each side."""
    def leafs(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        _, at = _best_cut(g.sum(axis=1), h.sum(axis=1))
        out, total = np.zeros(g.shape), 0.0
        for rows in (slice(0, at), slice(at, None)):
            _, cut = _best_cut(g[rows].sum(axis=0), h[rows].sum(axis=0))
            for cols in (slice(0, cut), slice(cut, None)):
                sum_g, sum_h = g[rows, cols].sum(), h[rows, cols].sum()
                out[rows, cols] = sum_g / (sum_h + 1.0)
                total += float(_gain(sum_g, sum_h))
        return total, out

    first, second = leafs(g, h), leafs(g.T, h.T)
    return first[1] if first[0] >= second[0] else second[1].T


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS) -> Model:
    """Boost one shallow tree per feature in turn, then the pairs that explain most of what is left.

    One class only, or no rows: the share of label 1 (0.5 without rows) for every text.
    """
    rows, width = x.shape
    rate = (y.sum() + 1.0) / (rows + 2.0)
    model = Model(float(np.log(rate / (1 - rate))), [np.empty(0)] * width, [np.zeros(1)] * width)
    if not rows or y.min() == y.max():
        return model
    model.cuts = [_cuts(x[:, j], BINS) for j in range(width)]
    binned = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    odds = np.full(rows, model.start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-odds))
        return y - p, np.maximum(p * (1 - p), _EPSILON)

    for _ in range(rounds):
        for j, bins in enumerate(binned):
            g, h = slopes()
            n = len(model.tables[j])
            step = RATE * _tree(np.bincount(bins, g, n), np.bincount(bins, h, n))
            model.tables[j] += step
            odds += step[bins]
    coarse = [_cuts(x[:, j], PAIR_BINS) for j in range(width)]
    placed = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(coarse)]
    g, h = slopes()
    ranked = []
    for a in range(width):
        for b in range(a + 1, width):
            n = (len(coarse[a]) + 1, len(coarse[b]) + 1)
            cell = placed[a] * n[1] + placed[b]
            both_g, both_h = np.bincount(cell, g, n[0] * n[1]), np.bincount(cell, h, n[0] * n[1])
            ranked.append((float(_gain(both_g, both_h).sum()), a, b))
    chosen = [(a, b) for _, a, b in sorted(ranked, reverse=True)[:pairs]]
    tables = {p: np.zeros((len(coarse[p[0]]) + 1, len(coarse[p[1]]) + 1)) for p in chosen}
    for _ in range(pair_rounds):
        for a, b in chosen:
            g, h = slopes()
            shape = tables[a, b].shape
            cell = placed[a] * shape[1] + placed[b]
            step = RATE * _pair_tree(np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape))
            tables[a, b] += step
            odds += step[placed[a], placed[b]]
    model.pairs = [(a, b, coarse[a], coarse[b], tables[a, b]) for a, b in chosen]
    return model


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves no remainder by 5; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.slices(batch):
            x = features(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> pd.DataFrame:
    """Features and labels of at most ``rows`` labelled documents outside the held-out part."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.where("doc_id is not null and label in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # at most ``rows`` pairs of numbers are sent to the executors
    marked = texts.join(F.broadcast(known), "doc_id").mapInArrow(_featured, "doc_id long, label int, x array<double>")
    return marked.dropDuplicates(["doc_id"]).orderBy("doc_id").limit(rows).toPandas()


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on a bounded sample (see ``training_sample``); ids, languages and sources are no inputs."""
    sample = training_sample(docs, labels, rows)
    x = np.stack(sample["x"].to_list()) if len(sample) else np.empty((0, len(FEATURES)))
    return fit(x, sample["label"].to_numpy(dtype=float))


def _scores(texts: pa.Array, model: Model) -> np.ndarray:
    return model.score(features(texts))


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_scores(part.column("text"), model))], names=["doc_id", "score"])

    return run


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; null text scores as an empty one. No shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scored(model), "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _kept(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                yield part.filter(pa.array(_scores(part.column("text"), model) >= threshold))

    return run


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model accepts, with all their columns."""
    return docs.mapInArrow(_kept(model, threshold), docs.schema)
