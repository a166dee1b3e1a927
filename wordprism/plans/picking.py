"""Choose the first rows of each class in a reproducible hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 1537  # fixed value: the seed of every draw
_PREFIX = 4  # hexadecimal digits, i.e. 65,536 buckets per class


def draw_key(key: Column | str, seed: int = SEED) -> Column:
    """Pseudo-random sort key that depends only on the seed and the row's key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def first_per_class(df: DataFrame, quotas: DataFrame, label: str, key: str, seed: int = SEED) -> DataFrame:
    """Rows among the first ``n`` of their class in draw order.

    ``quotas`` has one row (label, n) per class. A histogram of the leading hash
    digits finds the bucket in which each quota runs out. Rows of earlier buckets
    are kept without ranking and only the rows of that one bucket are numbered,
    so a class that holds most of the table never meets in one task.
    """
    drawn = df.withColumn("_draw", draw_key(key, seed)).withColumn("_bucket", F.substring("_draw", 1, _PREFIX))
    histogram = drawn.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    upto = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    sizes = histogram.withColumn("_upto", F.sum("_size").over(upto))
    cut = (
        sizes.join(quotas.select(label, F.col("n").cast("long").alias("_n")), label)
        .where(F.col("_upto") - F.col("_size") < F.col("_n"))
        .select(label, "_bucket", F.when(F.col("_upto") > F.col("_n"), F.col("_n") - F.col("_upto") + F.col("_size")).alias("_open"))
    )
    marked = drawn.join(cut, [label, "_bucket"])  # both keys, so a class is spread over its buckets
    inside = marked.where(F.col("_open").isNull())
    numbered = Window.partitionBy(label, "_bucket").orderBy("_draw", key)
    border = (
        marked.where(F.col("_open").isNotNull())
        .withColumn("_rn", F.row_number().over(numbered))
        .where(F.col("_rn") <= F.col("_open"))
        .drop("_rn")
    )
    return inside.unionByName(border).select(*df.columns)
