"""Exact row numbers over a whole table without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordprism.session import checkpoint_dir

_ROW_BITS = 33  # monotonically_increasing_id keeps the row within its partition in the low bits


def with_global_rank(df: DataFrame, order: list[str], name: str = "idx", partitions: int | None = None) -> DataFrame:
    """Add the 0-based position of each row in the order of ``order``.

    The rows are range partitioned and sorted once and checkpointed, so that the
    partition borders cannot move; only one count per partition is accumulated.
    ``order`` must be a key of ``df``.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    split = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    split = split.sortWithinPartitions(*order)
    split = split.withColumn("_mid", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_mid", _ROW_BITS)
    row = F.col("_mid").bitwiseAND((1 << _ROW_BITS) - 1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        split.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        split.withColumn("_part", part)
        .join(offsets, "_part")
        .withColumn(name, (row + F.col("_offset")).cast("long"))
        .drop("_part", "_offset", "_mid")
    )
