"""Keep all cores busy on inputs that arrive in fewer partitions than there are cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a small input over the cluster; leave a large one where it is.

    A table with at least as many splits as cores is returned untouched, so no
    shuffle is added to a large scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(2 * cores)


def deal(df: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """Hash partition rows whose groups are small in bytes but heavy to compute.

    A stated number of partitions is not merged by their size at run time, which
    would put many heavy groups into one task. Grouping by ``keys`` adds no shuffle.
    """
    count = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(count, *keys)
