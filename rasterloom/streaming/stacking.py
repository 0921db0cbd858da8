"""An extension: a running average over frames that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_average(px: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Mean of each pixel over the frames of each time window; rows later than `late` are left out of closed windows."""
    return px.withWatermark(time, late).groupBy(F.window(time, window), "burst", "y", "x", "c").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n_frames"))
