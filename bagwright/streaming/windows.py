"""Event-time windows: the same functions on streaming and on static DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, time: str, late: str | None) -> DataFrame:
    return df.withWatermark(time, late) if late and df.isStreaming else df


def tumbling(df: DataFrame, time: str, size: str, keys: Sequence[str], aggregates: Sequence[Column], late: str | None = None) -> DataFrame:
    """(start, end, keys, aggregates) per window of `size`; on streams rows later than `late` are left out."""
    return sliding(df, time, size, size, keys, aggregates, late)


def sliding(df: DataFrame, time: str, size: str, every: str, keys: Sequence[str], aggregates: Sequence[Column], late: str | None = None) -> DataFrame:
    out = _late(df, time, late).groupBy(F.window(time, size, every).alias("_w"), *keys).agg(*aggregates)
    return out.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *[c for c in out.columns if c != "_w"])


def sessions(df: DataFrame, time: str, gap: str, keys: Sequence[str], aggregates: Sequence[Column], late: str | None = None) -> DataFrame:
    """(start, end, keys, aggregates) per session: events of a key less than `gap` apart."""
    out = _late(df, time, late).groupBy(F.session_window(time, gap).alias("_w"), *keys).agg(*aggregates)
    return out.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *[c for c in out.columns if c != "_w"])


def append(df: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends df to Parquet files once each row is final, as far as there is input."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
