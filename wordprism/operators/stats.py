"""Token frequencies, frequency filters and report summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordprism.plans.tables import stored

# The spread allowed below and above the middle half (of log10 frequency).
LOWER_SPREAD, UPPER_SPREAD = 0.1, 1.5
LOWEST_FREQUENCY = 3
MOST_WORDS = 70


def token_frequency(rows: DataFrame) -> DataFrame:
    """Occurrences (not texts) per token: ``token, frequency``."""
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("frequency"))


def frequency_histogram(frequencies: DataFrame) -> DataFrame:
    """``frequency, n_tokens``."""
    return frequencies.groupBy("frequency").agg(F.count(F.lit(1)).alias("n_tokens"))


def _frequency_bounds(frequencies: DataFrame, lowest: int) -> Column:
    """One struct of bounds for a frequency table, as a scalar subquery.

    Fields: ``n`` and ``n_inner`` distinct frequencies in all and strictly between
    the extremes, ``low`` and ``high`` the quartile bounds of log10 frequency.
    Tokens are reduced to their histogram first, so the quartiles are taken over
    distinct frequencies with their numbers of tokens.
    """
    histogram = frequency_histogram(frequencies)
    ends = histogram.agg(
        F.struct(
            F.greatest(F.min("frequency"), F.lit(lowest)).alias("lo"), F.max("frequency").alias("hi"),
            F.count(F.lit(1)).alias("n"),
        )
    ).scalar()
    lo, hi = ends["lo"], ends["hi"]
    quartiles = histogram.where((F.col("frequency") > lo) & (F.col("frequency") < hi)).agg(
        F.count(F.lit(1)).alias("n_inner"), F.expr("percentile(log10(frequency), array(0.25, 0.75), n_tokens)").alias("q")
    )
    q1, q3 = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    low = F.greatest(lo.cast("double"), F.pow(F.lit(10.0), q1 - LOWER_SPREAD * (q3 - q1)))
    high = F.least(hi.cast("double"), F.pow(F.lit(10.0), q3 + UPPER_SPREAD * (q3 - q1)))
    return quartiles.select(
        F.struct(ends["n"].alias("n"), "n_inner", lo.alias("lo"), hi.alias("hi"), low.alias("low"), high.alias("high"))
    ).scalar()


def iqr_filter(frequencies: DataFrame, lowest: int = 1) -> DataFrame:
    """Tokens strictly inside the asymmetric quartile bounds of log10 frequency.

    ``lowest`` lifts the minimum. Nothing strictly inside gives an empty result.
    The frequencies are written once, since bounds and result both read them.
    """
    frequencies = stored(frequencies, "frequencies")
    bounds = _frequency_bounds(frequencies, lowest)
    inside = (F.col("frequency") > bounds["low"]) & (F.col("frequency") < bounds["high"])
    return frequencies.where((bounds["n_inner"] > 0) & inside)


def zipf_filter(frequencies: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """The most telling words: quartile bounds, then the ``most`` frequent ones.

    The bounds apply only where at least four distinct frequencies exist, both
    before and after the extremes are trimmed; otherwise every token competes.
    The frequencies are written once, since bounds and result both read them.
    """
    frequencies = stored(frequencies, "frequencies")
    bounds = _frequency_bounds(frequencies, LOWEST_FREQUENCY)
    bounded = (bounds["lo"] != bounds["hi"]) & (bounds["n"] > 3) & (bounds["n_inner"] > 3)
    inside = (F.col("frequency") > bounds["low"]) & (F.col("frequency") < bounds["high"])
    return (
        frequencies.where(~bounded | inside)
        .orderBy(F.desc("frequency"), F.desc("token"))
        .limit(most)
    )


def class_report(predictions: DataFrame, classes: DataFrame) -> DataFrame:
    """Precision, recall, f1, support per class and the accuracy.

    ``predictions(label, predicted)`` and ``classes(class)``; 0 where undefined.
    """
    pairs = predictions.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called")),
                F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called")),
            )
        ).alias("s"),
        F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"),
    )
    per_class = sides.groupBy("s.class").agg(
        F.sum("s.support").alias("support"),
        F.sum("s.called").alias("called"),
        F.sum(F.when(F.col("s.support") > 0, F.col("hit")).otherwise(0)).alias("hits"),
    )
    accuracy = pairs.agg(
        F.try_divide(F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)), F.sum("n"))
    ).scalar()
    full = classes.select("class").distinct().join(per_class, "class", "left").na.fill(0)
    precision = F.coalesce(F.try_divide("hits", "called"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * F.col("hits"), F.col("called") + F.col("support")), F.lit(0.0))
    return full.select(
        "class",
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1"),
        F.col("support").cast("long").alias("support"),
        F.coalesce(accuracy, F.lit(0.0)).alias("accuracy"),
    )


def report_summary(report: DataFrame) -> DataFrame:
    """Plain averages over the classes and the accuracy."""
    return report.agg(
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"),
        F.max("accuracy").alias("accuracy"),
    )


def infidelity_summary(per_row: DataFrame) -> DataFrame:
    """Mean and sample standard deviation of ``infidelity``."""
    return per_row.agg(F.avg("infidelity").alias("mean"), F.stddev_samp("infidelity").alias("std"))
