"""Token vectors, pooled text vectors and text-token weights."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from wordprism.functions import text as tx
from wordprism.operators.tokens import TOKEN

DIMENSIONS = 8
_SLICE = 1 << 17  # tokens that are encoded and sent back at once


def _components(tokens: pa.StringArray, dimensions: int) -> np.ndarray:
    """``[token, component]``: numbers of 16 bits from the md5 digits of a token; each md5 block holds eight."""
    blocks = -(-dimensions // DIMENSIONS)
    digests = (hashlib.md5(t if block == 0 else f"{block}:".encode() + t).digest() for t in tokens.cast(pa.binary()).to_pylist() for block in range(blocks))
    return np.frombuffer(b"".join(digests), dtype=">u2").reshape(len(tokens), blocks * DIMENSIONS)[:, :dimensions].astype(np.int64)


def _measures(vec: np.ndarray, how: str) -> np.ndarray:
    """One number per vector, summed from the first component on: its length (``norm``) or the mean of its components."""
    total = np.zeros(len(vec))
    for x in vec.T:
        total += x * x if how == "norm" else x
    return np.sqrt(total) if how == "norm" else total / vec.shape[1]


def _encoder(dimensions: int, layer: int, keep: list[str], spans: bool, measure: str | None):
    """Texts as lists of pieces in; per token its place and its vector out, or per distinct token of a text its measures."""

    def encoded(rows: pa.RecordBatch) -> pa.RecordBatch:
        lists = rows.column("pieces")
        size = lists.value_lengths().to_numpy()
        pieces = lists.flatten()
        token = pc.utf8_ltrim(pieces, characters=tx.BLANKS) if spans else pieces
        coded = pc.dictionary_encode(token)
        own = _components(coded.dictionary, dimensions)[coded.indices.to_numpy()]
        owner = np.repeat(np.arange(len(size)), size)
        begin = np.cumsum(size) - size
        pos = np.arange(len(owner)) - begin[owner]
        follows = np.flatnonzero(pos > 0)  # tokens with one before them in their text
        total, n = own.copy(), np.ones(len(owner), dtype=np.int64)
        total[follows] += own[follows - 1]
        total[follows - 1] += own[follows]
        n[follows] += 1
        n[follows - 1] += 1
        vec = total / (n * 65535.0)[:, None] - 0.5  # the mean of n components x / 65535 - 0.5
        if measure:
            kinds = max(len(coded.dictionary), 1)
            cell, place = np.unique(owner * kinds + coded.indices.to_numpy(), return_inverse=True)
            columns = [rows.column(c).take(pa.array(cell // kinds)) for c in ("text_id", *keep)]
            columns += [pa.array(np.full(len(cell), layer, dtype=np.int32)), coded.dictionary.take(pa.array(cell % kinds))]
            columns += [pa.array(np.bincount(place, _measures(vec, measure), len(cell))), pa.array(np.bincount(place, minlength=len(cell)))]
            return pa.RecordBatch.from_arrays(columns, names=["text_id", *keep, "layer", "token", "total", "n"])
        columns = [rows.column(c).take(pa.array(owner)) for c in ("text_id", *keep)]
        columns += [pa.array(np.full(len(owner), layer, dtype=np.int32)), pa.array(pos.astype(np.int32)), token]
        if spans:
            length = pc.utf8_length(pieces).to_numpy()
            upto = np.concatenate([[0], np.cumsum(length)])
            end = upto[1:] - upto[begin][owner]
            columns += [pa.array((end - pc.utf8_length(token).to_numpy()).astype(np.int32)), pa.array(end.astype(np.int32))]
        at = pa.array(np.arange(len(owner) + 1, dtype=np.int32) * dimensions)
        columns.append(pa.ListArray.from_arrays(at, pa.array(vec.reshape(-1))))
        names = ["text_id", *keep, "layer", "pos", "token", *(["start", "end"] if spans else []), "vec"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            upto = np.cumsum(batch.column("pieces").value_lengths().to_numpy())
            first = 0
            while first < batch.num_rows:
                done = upto[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(upto, done + _SLICE, side="right")))
                yield encoded(batch.slice(first, last - first))
                first = last

    return run


def encode_hashed(
    texts: DataFrame, dimensions: int = DIMENSIONS, layer: int = 0, keep: tuple[str, ...] = (), spans: bool = True,
    measure: str | None = None,
) -> DataFrame:
    """Default encoder: token hash vectors averaged with their neighbours.

    The vector of a token comes from md5 digits. Deterministic, in context and
    without a model; a text is encoded within its own row, without a shuffle. Tokens
    are cut by Spark; their digests are taken once per distinct token of a batch.
    Leave out ``spans`` where only vectors are needed. Where only their ``measure`` is (``norm``
    or ``mean``), a row of a text gives ``token, total, n`` per distinct token: the sum over
    its occurrences there and their number, so vectors do not leave the task.
    """
    if measure and spans:
        raise ValueError("measures have no spans")
    pieces = F.regexp_extract_all("text", F.lit(r"\s*" + TOKEN if spans else TOKEN), F.lit(0))
    split = texts.select("text_id", *keep, pieces.alias("pieces")).where(F.size("pieces") > 0)
    ends = [("start", IntegerType()), ("end", IntegerType())] if spans else []
    made = [("layer", IntegerType()), ("pos", IntegerType()), ("token", StringType()), *ends, ("vec", ArrayType(DoubleType()))]
    if measure:
        made = [("layer", IntegerType()), ("token", StringType()), ("total", DoubleType()), ("n", LongType())]
    schema = StructType([*(split.schema[c] for c in ("text_id", *keep)), *(StructField(*m) for m in made)])
    return split.mapInArrow(_encoder(dimensions, layer, list(keep), spans, measure), schema)


Encoder = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
ENCODED = "text_id string, layer int, pos int, token string, start int, end int, vec array<float>"


def encode_with(texts: DataFrame, encoder: Encoder) -> DataFrame:
    """Vectors from a plug-in: batches of (text_id, text) in, token rows out.

    The plug-in is an iterator function, so a model is loaded once per task.
    """
    return texts.select("text_id", "text").mapInPandas(encoder, ENCODED)


def resolve_layers(requested: list[int] | None, n_layers: int) -> list[int]:
    """Absolute layer numbers; the last one by default, negatives count back."""
    chosen = requested or [-1]
    if any(not -n_layers <= i < n_layers for i in chosen):
        raise ValueError(f"layers must lie between {-n_layers} and {n_layers - 1}")
    return [i % n_layers for i in chosen]


def choose_layers(token_vec: DataFrame, requested: list[int] | None, n_layers: int) -> DataFrame:
    return token_vec.where(F.col("layer").isin(resolve_layers(requested, n_layers)))


def mean_pool(
    token_vec: DataFrame,
    dimensions: int,
    texts: DataFrame | None = None,
    mask: Column | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Masked mean of token vectors per text and layer: ``text_id, layer, vec``.

    With ``texts`` given, a text without tokens gets a vector of zeros.
    """
    m = F.lit(1.0) if mask is None else mask.cast("double")
    keys = ["text_id", "layer", *keep]
    vec = F.col("vec").cast("array<double>")
    rows = token_vec.where(F.col("vec").isNotNull()).select(*keys, m.alias("_m"), vec.alias("_x"))
    # plain sums, which are hash-aggregated within a task whatever the number of texts; a vector-valued sum sorts and moves every token
    part = (lambda k: F.col("_x")[k]) if mask is None else (lambda k: F.col("_x")[k] * F.col("_m"))
    sums = [F.sum(part(k)).alias(f"_s{k}") for k in range(dimensions)]
    summed = rows.groupBy(*keys).agg(*sums, F.greatest(F.sum("_m"), F.lit(1e-9)).alias("_w"))
    pooled = summed.select(*keys, F.array(*[F.col(f"_s{k}") / F.col("_w") for k in range(dimensions)]).alias("vec"))
    if texts is None:
        return pooled
    zeros = F.array_repeat(F.lit(0.0), dimensions)
    return (
        texts.select("text_id", *keep).join(pooled.drop(*keep), "text_id", "left")
        .select(*[F.coalesce("layer", F.lit(0)).alias("layer") if k == "layer" else F.col(k) for k in keys],
                F.coalesce("vec", zeros).alias("vec"))
    )


def norm(vec: Column | str) -> Column:
    vec = F.col(vec) if isinstance(vec, str) else vec
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def token_weights(token_vec: DataFrame, how: str = "norm", dimensions: int | None = None, single: bool = False) -> DataFrame:
    """``text_id, layer, token, weight``: a token's vectors in a text as one number.

    ``norm``: mean over occurrences of the vector length. ``mean``: mean of the
    mean vector. A known number of ``dimensions`` keeps the expression flat. Rows that
    were measured when they were encoded (``total, n``) are only summed, and not even moved
    where every text is known to be a ``single`` row.
    """
    if "vec" not in token_vec.columns:
        if single:
            return token_vec.select("text_id", "layer", "token", (F.col("total") / F.col("n")).alias("weight"))
        return token_vec.groupBy("text_id", "layer", "token").agg((F.sum("total") / F.sum("n")).alias("weight"))
    if dimensions is None:
        length = norm("vec")
        average = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x.cast("double")) / F.size("vec")
    else:
        parts = [F.col("vec")[k].cast("double") for k in range(dimensions)]
        length = F.sqrt(sum((F.pow(x, F.lit(2.0)) for x in parts), F.lit(0.0)))
        average = sum(parts, F.lit(0.0)) / dimensions
    value = {"norm": length, "mean": average}[how]
    return token_vec.groupBy("text_id", "layer", "token").agg(F.avg(value).alias("weight"))


def text_token_matrix(weights: DataFrame, vocab: DataFrame) -> DataFrame:
    """Sparse long matrix ``text_id, idx, weight``; an absent cell is 0."""
    return weights.join(vocab, "token").select("text_id", "idx", "weight")


def sparse_rows(matrix: DataFrame) -> DataFrame:
    """One row per text: ``text_id, idx array<long>, val array<double>`` in index order."""
    cells = F.array_sort(F.collect_list(F.struct("idx", "weight")))
    rows = matrix.groupBy("text_id").agg(cells.alias("c"))
    return rows.select(
        "text_id", F.transform("c", lambda s: s["idx"]).alias("idx"), F.transform("c", lambda s: s["weight"]).alias("val")
    )
