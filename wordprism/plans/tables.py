"""Intermediate results that several later steps read."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from wordprism.session import scratch_path

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage ends at the files, lost executors recompute nothing before them,
    and the planner knows the size of the table, so it broadcasts only what fits. What was
    shuffled for the table goes when it is written, not when the driver happens to collect its garbage.
    """
    path, conf = scratch_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove the files of a table of :func:`stored` that nothing reads any more, so that the tables of many rounds do not add up."""
    context = table.sparkSession.sparkContext
    for folder in {os.path.dirname(file) for file in table.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getParent().getName() != "tables":
            raise ValueError(f"{folder} is no stored table")
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
