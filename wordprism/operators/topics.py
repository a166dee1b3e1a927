"""Bags of words, TF-IDF and topic models over prepared words."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import LDA
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordprism.operators.geometry import second_moments
from wordprism.plans.tables import stored

# Limits on document frequency and on the number of terms.
MIN_SHARE, MAX_SHARE, MOST_TERMS = 0.05, 0.95, 1000
TOPICS, WORDS_PER_TOPIC = 5, 3
_REPLAYED = 10  # updates that a task repeats before the row factors are stored


def count_terms(words: DataFrame, texts: DataFrame) -> DataFrame:
    """``term, idx, df``: terms of two letters or more within the frequency limits.

    At most 1,000 terms, by total count (ties to the smaller term), numbered in order.
    A word has at least as many rows as texts, so only words with enough rows meet the texts.
    """
    n = texts.agg(F.count(F.lit(1))).scalar()
    long = words.where(F.length("word") >= 2).select("text_id", F.col("word").alias("term"))
    totals = long.groupBy("term").agg(F.count(F.lit(1)).alias("total"))
    usual = stored(totals.where(F.col("total") >= MIN_SHARE * n), "usual")
    per_text = long.join(usual.select("term"), "term", "left_semi").distinct()
    found = per_text.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    inside = found.where((F.col("df") >= MIN_SHARE * n) & (F.col("df") <= MAX_SHARE * n)).join(usual, "term")
    best = inside.orderBy(F.desc("total"), "term").limit(MOST_TERMS)
    order = Window.orderBy("term")  # at most 1,000 rows
    return best.select("term", (F.row_number().over(order) - 1).cast("long").alias("idx"), "df")


def count_matrix(words: DataFrame, terms: DataFrame) -> DataFrame:
    """``text_id, term, idx, n``: sparse counts of the chosen terms; the other words leave before they are counted."""
    chosen = words.select("text_id", F.col("word").alias("term")).join(terms.select("term", "idx"), "term")
    return chosen.groupBy("text_id", "term", "idx").agg(F.count(F.lit(1)).alias("n"))


def tfidf_matrix(counts: DataFrame, terms: DataFrame, texts: DataFrame) -> DataFrame:
    """``text_id, term, idx, weight``: n (ln((1 + N) / (1 + df)) + 1), rows of length 1."""
    n = texts.agg(F.count(F.lit(1))).scalar()
    idf = F.log((1 + n) / (1 + F.col("df"))) + 1.0
    raw = counts.join(terms.select("term", "df"), "term").withColumn("_w", F.col("n") * idf)
    lengths = raw.groupBy("text_id").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_l"))
    return raw.join(lengths, "text_id").select("text_id", "term", "idx", (F.col("_w") / F.col("_l")).alias("weight"))


def term_vectors(matrix: DataFrame, texts: DataFrame, size: int, value: str) -> DataFrame:
    """``text_id, features``: one sparse vector per text, empty ones included."""
    cells = matrix.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.col(value).cast("double").alias("v")))).alias("c"))

    @F.udf(VectorUDT())
    def vector(idx, val):
        return SparseVector(size, idx or [], val or [])

    rows = texts.select("text_id").join(cells, "text_id", "left")
    return rows.select("text_id", vector(F.transform("c", lambda x: x["idx"]), F.transform("c", lambda x: x["v"])).alias("features"))


def fit_lda(vectors: DataFrame, terms: DataFrame, topics: int = TOPICS, seed: int = 1537) -> tuple[DataFrame, DataFrame]:
    """Online variational LDA: ``topic, term, weight`` and ``text_id, topic, weight``.

    Every update passes over the vectors, so they are written once.
    """
    vectors = stored(vectors, "vectors")
    model = LDA(k=topics, maxIter=5, optimizer="online", learningOffset=50.0, learningDecay=0.7, subsamplingRate=1.0, seed=seed).fit(vectors)
    mixed = model.transform(vectors).select("text_id", F.posexplode(vector_to_array("topicDistribution")).alias("topic", "weight"))
    return _term_table(vectors.sparkSession, model.topicsMatrix().toArray().T, terms), mixed


def _term_table(spark, components: np.ndarray, terms: DataFrame) -> DataFrame:
    """Topic rows over at most 1,000 terms as a table."""
    k, m = components.shape
    rows = pd.DataFrame({"topic": np.repeat(np.arange(k), m), "idx": np.tile(np.arange(m), k), "weight": components.ravel()})
    table = spark.createDataFrame(rows).select(F.col("topic").cast("int"), "idx", "weight")
    return table.join(terms.select("idx", "term"), "idx").select("topic", "term", "weight")


def _dense(batch: pd.DataFrame, m: int) -> np.ndarray:
    x = np.zeros((len(batch), m))
    for r, (idx, val) in enumerate(zip(batch["idx"], batch["val"])):
        x[r, np.asarray(idx, dtype=np.int64)] = val
    return x


def fit_nmf(
    matrix: DataFrame, terms: DataFrame, topics: int = TOPICS, steps: int = 1000, tolerance: float = 1e-4, seed: int = 1537
):
    """Non-negative factors by multiplicative updates.

    Returns ``topic, term, weight``, ``text_id, topic, weight`` and the losses. The
    topics-by-terms factor is small; the rows of the other one are stored every few
    steps and updated in their task in between, so each step is one pass that
    returns sums. Stops when ten steps lower the error by less than ``tolerance``
    of the first error; raises if that has not happened after ``steps``. Texts
    without terms have no rows.
    """
    spark = matrix.sparkSession
    m = terms.count()
    rows = matrix.groupBy("text_id").agg(F.collect_list(F.col("idx")).alias("idx"), F.collect_list("weight").alias("val"))
    factor = stored(rows.withColumn("w", F.array_repeat(F.lit(0.1), topics)), "factor")
    rng = np.random.default_rng(seed)
    recent = [0.1 + rng.random((topics, m)) / np.sqrt(m)]
    tiny = 1e-12

    def updated(batch: pd.DataFrame, x: np.ndarray, past: list[np.ndarray]) -> np.ndarray:
        w = np.stack([np.asarray(v, dtype=np.float64) for v in batch["w"]])
        for h in past:
            w = w * (x @ h.T) / np.maximum(w @ (h @ h.T), tiny)
        return w

    def sums(past: list[np.ndarray]):
        def run(batches):
            total = np.zeros((topics, m + topics))
            loss = 0.0
            for batch in batches:
                if len(batch):
                    x = _dense(batch, m)
                    w = updated(batch, x, past)
                    total[:, :m] += w.T @ x
                    total[:, m:] += w.T @ w
                    loss += float(((x - w @ past[-1]) ** 2).sum())
            yield pd.DataFrame({"topic": np.arange(topics), "s": list(total), "loss": [loss] + [0.0] * (topics - 1)})

        return run

    def advance(past: list[np.ndarray]):
        def run(batches):
            for batch in batches:
                if len(batch):
                    yield batch.assign(w=list(updated(batch, _dense(batch, m), past)))

        return run

    losses = []
    for _ in range(steps):
        parts = factor.mapInPandas(sums(list(recent)), "topic int, s array<double>, loss double")
        # partial sums of the partitions meet per topic and term
        merged = parts.select("topic", "loss", F.posexplode("s").alias("i", "v")).groupBy("topic", "i").agg(
            F.sum("v").alias("v"), F.sum(F.when(F.col("i") == 0, F.col("loss")).otherwise(0.0)).alias("loss")
        ).toPandas()
        total = np.zeros((topics, m + topics))
        total[merged["topic"], merged["i"]] = merged["v"]
        losses.append(float(merged["loss"].sum()))
        h = recent[-1]
        recent.append(h * total[:, :m] / np.maximum(total[:, m:] @ h, tiny))
        if len(recent) > _REPLAYED:
            factor = stored(factor.mapInPandas(advance(recent[:-1]), factor.schema), "factor")
            recent = recent[-1:]
        if len(losses) > 10 and np.sqrt(losses[-11]) - np.sqrt(losses[-1]) <= tolerance * np.sqrt(losses[0]):
            break
    else:
        raise RuntimeError(f"the factors have not settled in {steps} steps")
    last = stored(factor.mapInPandas(advance(recent), factor.schema), "factor")
    mixed = last.select("text_id", F.posexplode("w").alias("topic", "weight"))
    return _term_table(spark, recent[-1], terms), mixed, losses


def fit_svd(matrix: DataFrame, texts: DataFrame, terms: DataFrame, topics: int = TOPICS):
    """Truncated SVD: ``topic, term, weight`` and ``text_id, topic, weight``.

    The second moments of at most 1,000 terms are summed by Spark; the largest
    loading of a component is positive. Moments and scores read the cells and the
    vectors, which are written once.
    """
    matrix = stored(matrix, "matrix")
    vectors = stored(term_vectors(matrix, texts, terms.count(), "weight"), "vectors")
    n, mean, cov = second_moments(vectors, "features")
    values, axes = np.linalg.eigh(cov * (n - 1) / n + np.outer(mean, mean))
    main = axes[:, np.argsort(values)[::-1][:topics]].T
    main = main * np.sign(main[range(len(main)), np.abs(main).argmax(axis=1)])[:, None]
    components = _term_table(matrix.sparkSession, main, terms)
    scores = matrix.join(components.withColumnRenamed("weight", "_c"), "term").groupBy("text_id", "topic").agg(
        F.sum(F.col("weight") * F.col("_c")).alias("weight")
    )
    return components, scores


def topic_words(components: DataFrame, words: int = WORDS_PER_TOPIC) -> DataFrame:
    """``topic, name``: the heaviest words of a topic joined by dashes; weights that agree to nine decimals go by term."""
    best = Window.partitionBy("topic").orderBy(F.desc(F.round("weight", 9)), "term")
    top = components.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= words)
    listed = top.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("_rn", "term"))).alias("l"))
    return listed.select("topic", F.array_join(F.transform("l", lambda x: x["term"]), "-").alias("name"))


def assign_topics(mixed: DataFrame, names: DataFrame, texts: DataFrame) -> DataFrame:
    """``text_id, topic`` for every text: the name of its heaviest topic, the first on ties.

    A text without terms has weight 0 for all topics, so it gets topic 0.
    """
    best = mixed.groupBy("text_id").agg(F.min_by("topic", F.struct(-F.col("weight"), "topic")).alias("topic"))
    every = texts.select("text_id").join(best, "text_id", "left").withColumn("topic", F.coalesce("topic", F.lit(0)))
    return every.join(names, "topic").select("text_id", F.col("name").alias("topic"))
