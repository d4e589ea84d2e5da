"""Windows over event time. The same functions serve batch and streaming DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, time: str, lateness: str | None) -> DataFrame:
    return df.withWatermark(time, lateness) if lateness and df.isStreaming else df


def tumbling(df: DataFrame, time: str, width: str, keys: Sequence[str], *aggregates: Column, slide: str | None = None, lateness: str | None = "10 minutes") -> DataFrame:
    """window_start, window_end, keys, aggregates by fixed (or, with slide, overlapping) windows."""
    window = F.window(F.col(time), width, slide) if slide else F.window(F.col(time), width)
    out = _late(df, time, lateness).groupBy(window.alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def sessions(df: DataFrame, time: str, gap: str, keys: Sequence[str], *aggregates: Column, lateness: str | None = "10 minutes") -> DataFrame:
    """window_start, window_end, keys, aggregates by runs of events with no gap longer than `gap`."""
    out = _late(df, time, lateness).groupBy(F.session_window(F.col(time), gap).alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])
