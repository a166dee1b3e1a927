"""Class quotas, stratified samples and the train/test split."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordprism.plans.picking import SEED, draw_key, first_per_class


def quota_numbers(sizes: list[int], n: int) -> list[int]:
    """How many rows each class gives to a sample of ``n`` (classes in label order).

    Shares are even, rounded up, with the last class taking the rounding. Classes
    that are too small give all they have, and what they lack is dealt evenly to
    the classes with rows left, the remainder to the last of those. A share below
    zero is set to zero and taken back from the last classes.
    """
    if n > sum(sizes):
        raise ValueError(f"sample of {n} from {sum(sizes)} rows")
    if not sizes:
        return []
    share = math.ceil(n / len(sizes))
    quota = [share] * len(sizes)
    quota[-1] += n - sum(quota)
    over = -min(quota[-1], 0)
    quota[-1] = max(quota[-1], 0)
    for i in range(len(quota) - 1, -1, -1):
        take = min(over, quota[i])
        quota[i] -= take
        over -= take
    while any(size < q for size, q in zip(sizes, quota)):
        quota = [min(size, q) for size, q in zip(sizes, quota)]
        missing = n - sum(quota)
        open_ = [i for i, (size, q) in enumerate(zip(sizes, quota)) if size > q]
        if not open_:
            break
        each, rest = divmod(missing, len(open_))
        for i in open_:
            quota[i] += each
        quota[open_[-1]] += rest
    return quota


def quotas(texts: DataFrame, n: int, label: str = "label") -> DataFrame:
    """``label, n``: one row per class; only the class sizes reach the driver."""
    sizes = texts.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(label).collect()
    numbers = quota_numbers([row["count"] for row in sizes], n)
    rows = [(row[label], q) for row, q in zip(sizes, numbers)]
    return texts.sparkSession.createDataFrame(rows, f"{label} string, n long")


def stratified(texts: DataFrame, n: int, label: str = "label", key: str = "text_id", seed: int = SEED) -> DataFrame:
    """A sample of ``n`` texts with class quotas, drawn without replacement."""
    return first_per_class(texts, quotas(texts, n, label), label, key, seed)


def train_test(texts: DataFrame, per_class: int = 5, label: str = "label", key: str = "text_id", seed: int = SEED) -> DataFrame:
    """Add ``part`` (``test`` or ``train``).

    A class with more than ``per_class`` rows gives that many to the test part,
    a smaller one its first row (by ``ord``), a single row stays in training.
    """
    classes = texts.groupBy(label).agg(
        F.count(F.lit(1)).alias("_size"), F.min_by(key, "ord").alias("_first")
    )
    ranked = Window.partitionBy(label).orderBy("_draw", key)
    drawn = (
        texts.select(label, key, draw_key(key, seed).alias("_draw"))
        .withColumn("_rn", F.row_number().over(ranked))
        .where(F.col("_rn") <= per_class)  # each map task keeps only its own best rows
        .join(classes.where(F.col("_size") > per_class).select(label), label, "left_semi")
        .select(key)
    )
    firsts = classes.where(F.col("_size").between(2, per_class)).select(F.col("_first").alias(key))
    chosen = drawn.unionByName(firsts).withColumn("_test", F.lit(True))
    marked = texts.join(chosen, key, "left")
    part = F.when(F.col("_test"), "test").otherwise("train")
    return marked.select(*texts.columns, part.alias("part"))


def split_report(split: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class and part, and a total row."""
    counts = split.rollup(label).agg(
        F.count_if(F.col("part") == "train").alias("train"),
        F.count_if(F.col("part") == "test").alias("test"),
        F.count(F.lit(1)).alias("total"),
        F.grouping(label).alias("_all"),
    )
    name = F.when(F.col("_all") == 1, "total").otherwise(F.col(label))
    return counts.select(name.alias("class"), "train", "test", "total")
