"""Streams: score rows with bins frozen from a batch, and keep outcome statistics per window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scoring import assign


def score_stream(stream: DataFrame, variable: str, bins: DataFrame | list, val: str = "avg_target", output: str = "score") -> DataFrame:
    """``assign`` on a streaming DataFrame; the intervals are read when the query is built, levels are a static side of its join."""
    return assign(stream, variable, bins, val, output)


def windowed_rates(stream: DataFrame, time: str, bin_column: str, target: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """n_obs and sum_target of each bin in tumbling windows; rows later than ``late`` are dropped."""
    return (
        stream.withWatermark(time, late).groupBy(F.window(time, width), F.col(bin_column).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n_obs"), F.sum(F.col(target).cast("double")).alias("sum_target"))
    )
