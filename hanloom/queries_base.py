"""What queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread_small(df: DataFrame) -> DataFrame:
    """``df`` on all cores where a table has fewer splits than those; larger tables stay as they are read, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
