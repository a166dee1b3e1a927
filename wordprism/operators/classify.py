"""Scaling, a linear classifier as a coefficient table, scoring by joins.

Cells ``text_id, token, weight`` are sparse: an absent cell is 0. A model is two
tables: ``coef(class, token, weight)``, complete over classes and tokens, and
``classes(class, bias, a, b)`` with the sigmoid ``1 / (1 + exp(a * margin + b))``.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordprism.operators import svm


class LinearModel(NamedTuple):
    coef: DataFrame
    classes: DataFrame


def encode_labels(texts: DataFrame, label: str = "label") -> DataFrame:
    """Classes in sorted order with their codes from 0: ``label, code``."""
    order = Window.orderBy(label)  # one row per class
    return texts.select(label).where(F.col(label).isNotNull()).distinct().select(
        label, (F.row_number().over(order) - 1).cast("long").alias("code")
    )


def fit_minmax(cells: DataFrame, train: DataFrame, tokens: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Scaler ``token, lo, span`` of the training texts, zeros included.

    A token missing from any training text has minimum 0. A constant column has
    span 1. Where the cells of all other texts belong to a few ``others``, these are sent to the
    cells and left out, so that no cell is moved to look its text up.
    """
    n = train.agg(F.count(F.lit(1))).scalar()
    if others is None:
        own = cells.join(train.select("text_id"), "text_id", "left_semi")
    else:
        own = cells.where(F.col("text_id").isNotNull()).join(F.broadcast(others.select("text_id")), "text_id", "left_anti")
    seen = own.groupBy("token").agg(
        F.min("weight").alias("_min"), F.max("weight").alias("_max"), F.count(F.lit(1)).alias("_n")
    )
    full = tokens.select("token").join(seen, "token", "left")
    everywhere = F.col("_n") == n
    lo = F.when(everywhere, F.col("_min")).otherwise(F.least(F.coalesce("_min", F.lit(0.0)), F.lit(0.0)))
    hi = F.when(everywhere, F.col("_max")).otherwise(F.greatest(F.coalesce("_max", F.lit(0.0)), F.lit(0.0)))
    return full.select("token", lo.alias("lo"), F.when(hi > lo, hi - lo).otherwise(1.0).alias("span"))


def apply_minmax(cells: DataFrame, scaler: DataFrame, texts: DataFrame, complete: bool = False) -> DataFrame:
    """Scaled cells ``text_id, token, value`` of ``texts``; values are not clipped.

    ``complete`` tells that no cell belongs to another text, so that none has to be looked up.

    A token that every training text holds has a minimum above 0, so its absence
    is a negative value and becomes a row. Such tokens are at most as many as the
    shortest training text has. A minimum below 0 would turn every absent cell into
    a row, so the task that meets one fails.
    """
    own = cells.where(F.col("text_id").isNotNull()) if complete else cells.join(texts.select("text_id"), "text_id", "left_semi")
    present = own.join(scaler, "token").select(
        "text_id", "token", ((F.col("weight") - F.col("lo")) / F.col("span")).alias("value")
    )
    below = F.raise_error(F.concat(F.lit("negative weights of "), F.col("token"))).cast("double")
    value = F.when(F.col("lo") < 0, below).otherwise(-F.col("lo") / F.col("span"))
    raised = scaler.where(F.col("lo") != 0)
    lifted = raised.agg(F.collect_list(F.struct("token", value.alias("value")))).scalar()
    held = own.join(F.broadcast(raised.select("token")), "token", "left_semi").select("text_id", "token")  # no other cell has to be moved
    absent = texts.select("text_id", F.inline(lifted)).join(held, ["text_id", "token"], "left_anti")
    return present.unionByName(absent)


def _class_frame(classes: DataFrame, tokens: DataFrame) -> DataFrame:
    """Every class for every token; the classes travel as one short array."""
    names = classes.agg(F.array_sort(F.collect_set("class"))).scalar()
    return tokens.select("token", F.explode(names).alias("class"))


def fit_centroids(values: DataFrame, train: DataFrame, tokens: DataFrame) -> LinearModel:
    """Nearest class mean as a linear model: weight 2 mean, bias -|mean|^2."""
    sizes = train.groupBy(F.col("label").alias("class")).agg(F.count(F.lit(1)).alias("_n"))
    sums = (
        values.join(train.select("text_id", F.col("label").alias("class")), "text_id")
        .groupBy("class", "token").agg(F.sum("value").alias("_s"))
    )
    means = _class_frame(sizes, tokens).join(sums, ["class", "token"], "left").join(sizes, "class")
    means = means.select("class", "token", (F.coalesce("_s", F.lit(0.0)) / F.col("_n")).alias("m"))
    coef = means.select("class", "token", (2 * F.col("m")).alias("weight"))
    classes = means.groupBy("class").agg((-F.sum(F.col("m") * F.col("m"))).alias("bias"))
    return LinearModel(coef, classes.select("class", "bias", F.lit(-1.0).alias("a"), F.lit(0.0).alias("b")))


def fit_svm(values: DataFrame, train: DataFrame, vocab: DataFrame, c: float = 1.0, **settings) -> LinearModel:
    """One linear SVM per class against the rest (``svm.fit_dual``), and a sigmoid per class."""
    return with_sigmoids(svm.fit_dual(values, train, vocab, c, **settings))


def with_sigmoids(fit: svm.DualFit) -> LinearModel:
    """The machines as a model with probabilities; their sigmoids are fitted to the margins of the training rows."""
    curves = fit_sigmoids(fit.duals.select("class", F.col("margin").alias("m"), "hit"))
    return LinearModel(fit.coef, fit.bias.join(curves, "class").select("class", "bias", "a", "b"))


def fit_sigmoids(margin_rows: DataFrame, most_steps: int = 200) -> DataFrame:
    """``class, a, b`` with P = 1 / (1 + exp(a margin + b)), by Newton steps until they settle.

    ``margin_rows`` has ``class, m, hit``. Targets are smoothed by the class sizes.
    Each step is one aggregation that returns six sums per class; a step that
    does not lower a class's loss is halved. Raises after ``most_steps``.
    """
    spark = margin_rows.sparkSession
    rows = margin_rows.withColumn("m", F.col("m").cast("double")).persist()
    try:
        sizes = rows.groupBy("class").agg(F.count_if("hit").alias("p"), F.count(F.lit(1)).alias("n")).collect()
        at = {r["class"]: np.array([0.0, np.log((r["n"] - r["p"] + 1.0) / (r["p"] + 1.0))]) for r in sizes}
        goal = {r["class"]: ((r["p"] + 1.0) / (r["p"] + 2.0), 1.0 / (r["n"] - r["p"] + 2.0)) for r in sizes}
        best: dict[str, tuple[float, np.ndarray, np.ndarray]] = {}  # loss, place and step of the last accepted place
        moving = set(at)
        for _ in range(most_steps):
            if not moving:
                break
            known = spark.createDataFrame([(k, *map(float, at[k]), *goal[k]) for k in sorted(moving)], "class string, a double, b double, high double, low double")
            z = F.col("a") * F.col("m") + F.col("b")
            p, t, m = 1.0 / (1.0 + F.exp(z)), F.when(F.col("hit"), F.col("high")).otherwise(F.col("low")), F.col("m")
            loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - (1 - F.col("t")) * z
            sums = rows.join(F.broadcast(known), "class").withColumn("p", p).withColumn("t", t).groupBy("class").agg(
                F.sum(loss).alias("loss"), F.sum(m * (F.col("t") - F.col("p"))).alias("ga"), F.sum(F.col("t") - F.col("p")).alias("gb"),
                F.sum(m * m * F.col("p") * (1 - F.col("p"))).alias("haa"), F.sum(m * F.col("p") * (1 - F.col("p"))).alias("hab"),
                F.sum(F.col("p") * (1 - F.col("p"))).alias("hbb"),
            ).collect()
            for r in sums:
                k = r["class"]
                if k in best and r["loss"] > best[k][0] + 1e-12 * abs(best[k][0]):
                    step = best[k][2] / 2
                    best[k] = (*best[k][:2], step)
                else:
                    h = np.array([[r["haa"], r["hab"]], [r["hab"], r["hbb"]]]) + 1e-9 * np.eye(2)
                    step = -np.linalg.solve(h, np.array([r["ga"], r["gb"]]))
                    best[k] = (r["loss"], at[k], step)
                at[k] = best[k][1] + step
                if np.abs(step).max() <= 1e-6 * (1 + np.abs(at[k]).max()):
                    moving.discard(k)
        if moving:
            raise RuntimeError(f"the sigmoids of {sorted(moving)} have not settled in {most_steps} steps")
    finally:
        rows.unpersist()
    return spark.createDataFrame([(k, *map(float, v)) for k, v in sorted(at.items())], "class string, a double, b double")


def margins(values: DataFrame, texts: DataFrame, model: LinearModel) -> DataFrame:
    """``text_id, class, margin, a, b`` for every text and class."""
    sums = (
        values.join(texts.select("text_id"), "text_id", "left_semi").join(model.coef, "token")
        .groupBy("text_id", "class").agg(F.sum(F.col("value") * F.col("weight")).alias("_s"))
    )
    listed = model.classes.agg(F.array_sort(F.collect_list(F.struct("class", "bias", "a", "b")))).scalar()
    frame = texts.select("text_id", F.inline(listed))
    return frame.join(sums, ["text_id", "class"], "left").select(
        "text_id", "class", (F.col("bias") + F.coalesce("_s", F.lit(0.0))).alias("margin"), "a", "b"
    )


def probabilities(margin_rows: DataFrame, keys: tuple[str, ...] = ("text_id",)) -> DataFrame:
    """Class probabilities: sigmoids of the margins, scaled to sum to 1."""
    p = 1.0 / (1.0 + F.exp(F.col("a") * F.col("margin") + F.col("b")))
    rows = margin_rows.select(*keys, "class", "margin", p.alias("_p"))
    total = F.sum("_p").over(Window.partitionBy(*keys))  # one row per class
    return rows.select(*keys, "class", "margin", (F.col("_p") / total).alias("prob"))


def best_class(probability: DataFrame, keys: tuple[str, ...] = ("text_id",)) -> DataFrame:
    """Most probable class, the first in name order on ties."""
    order = F.struct(-F.col("prob"), "class")
    return probability.groupBy(*keys).agg(
        F.min_by("class", order).alias("predicted"), F.max("prob").alias("predicted_prob")
    )


def predict(values: DataFrame, texts: DataFrame, model: LinearModel) -> DataFrame:
    """``text_id, label, predicted, predicted_prob``."""
    best = best_class(probabilities(margins(values, texts, model)))
    return texts.select("text_id", "label").join(best, "text_id")
