"""How rows are spread before expensive narrow work."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

SMALL_INPUT = 256 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate: file sizes for scans, an upper bound after filters and aggregates."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread_small(df: DataFrame) -> DataFrame:
    """Give every core a share of a small input before CPU-heavy work on each row.

    A small table is often one file with one row group, which is one task. Moving it
    costs next to nothing. Larger inputs come in many splits and stay where they are.
    """
    if estimated_bytes(df) > SMALL_INPUT:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    # by value rather than round robin, which would first sort all rows to be repeatable
    plain = [field.name for field in df.schema if isinstance(field.dataType, T.AtomicType)]
    return df.repartition(cores, *plain)
