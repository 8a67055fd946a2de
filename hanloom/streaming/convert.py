"""The same operators on streams: they keep no state, so a stream is converted row by row as a table is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.engine import Engine


def converted(engine: Engine, stream: DataFrame, value: str, text_col: str = "text", punct: bool = False) -> DataFrame:
    """``stream`` with ``text_col`` converted; works on tables too."""
    return stream.withColumn(text_col, engine.convert(stream[text_col], value, punct))


def segmented(engine: Engine, stream: DataFrame, text_col: str = "text", mode: str = "cut") -> DataFrame:
    return stream.withColumn("tokens", engine.cut(stream[text_col], mode=mode))


def write(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet files, each row once; ``checkpoint`` must be a folder that all executors share."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").start(path)
