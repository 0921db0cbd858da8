"""Tone and output mapping of a merged frame (burst, y, x, c, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import stencil


def target_white(depth: int, sensor: float) -> float:
    return float(2**depth - 1) if 1 <= depth <= 16 else sensor


def snap_depth(depth: int, fmt: str) -> int:
    depth = min(16, max(8, depth))
    return 8 if fmt in ("jpeg", "bmp") else (8 if depth <= 8 else 16) if fmt in ("png", "tiff") else depth


def bit_depth(v: Column, depth: int, sensor: float, black: float) -> Column:
    """Scale black-subtracted values to the depth's white, adding black back above 10 bits."""
    k = target_white(depth, sensor) / sensor
    if depth <= 10 or black <= 1:
        return v * k
    return v + black if k == 1 else v * k + F.round(F.lit(black * k))


def black_delta(v: Column, c: Column, blacks: list[float], mean: float, k: float) -> Column:
    """Per-channel black offsets around the mean (0: the mean)."""
    deltas = F.array(*(F.round(F.lit(((b or mean) - mean) * k)) for b in blacks))
    return v + F.element_at(deltas, c + 1)


def exposure_linear(px: DataFrame, stops: float, white: float) -> DataFrame:
    px = px.withColumn("v", F.greatest(F.lit(0.0), F.col("v") * 2.0**stops))
    top = px.groupBy("burst").agg(F.max("v").alias("top"))  # small ones are broadcast at run time
    return px.join(top, "burst").withColumn("v", F.when(F.col("top") > white, F.col("v") * (white / F.col("top"))).otherwise(F.col("v"))).drop("top")


def exposure_curve(v: Column, stops: float, white: float) -> Column:
    x = F.greatest(F.lit(0.0), v * 2.0**stops)
    return white * x / (x + white)


def reinhard_local(px: DataFrame, stops: float, white: float, black_min: float, black_mean: float, radius: int = 1) -> DataFrame:
    """Local Reinhard curve with a doubly box-blurred luminance guide; px has one frame a burst."""
    top = px.groupBy("burst").agg(F.max("v").alias("top"))  # small ones are broadcast at run time
    px = stencil.large_blur(px.withColumn("frame", F.lit(0)), radius, out="guide").join(top, "burst")
    rescale = max(1.0, white - black_min)
    unit = lambda v: F.greatest(F.lit(0.0), F.least(v, F.lit(1.0)))
    lg = F.greatest(F.lit(1.0), F.least(0.9 * (white - black_min) / (F.greatest(F.lit(black_min + 1), F.col("top")) - black_min), F.lit(16.0)))
    px = px.withColumn("lg", lg).withColumn("gs", F.greatest(F.lit(0.0), F.least(stops - F.log2("lg"), F.lit(4.0))))
    px = px.withColumn("g0", F.pow(F.lit(2.0), F.col("gs") - 0.05 * F.greatest(F.lit(0.0), F.col("gs") - 1.5))).withColumn("g1", F.pow(F.lit(2.0), F.col("gs") / 1.4))
    guide = F.max("guide").over(W.partitionBy("burst", "y", "x"))
    px = px.withColumn("lum", F.greatest(F.lit(1e-12), F.least((guide - black_mean) / rescale, F.lit(1.0))))
    g0, g1, lum = F.col("g0"), F.col("g1"), F.col("lum")
    a0, a1 = F.col("lg") * g0 * lum, F.col("lg") * g1 * lum
    a0 = a0 * (1 + a0 / (g0 * g0)) / (1 + a0)
    lm = g1 * (0.4 + 1 / g1) / (0.4 + g1)
    a1 = a1 * (0.4 + a1 / (g1 * g1)) / ((0.4 + a1) * lm)
    w = unit(0.25 * F.col("gs"))
    scale = (a0 + (a1 - a0) * w) / lum
    v = unit((F.col("v") - black_min) / rescale) * scale * rescale + black_min
    return px.select("burst", "y", "x", "c", F.greatest(F.lit(0.0), F.least(v, F.lit(white))).alias("v"))


def quantize(v: Column, white: float, out_max: float | None = None) -> Column:
    """Whole numbers: clamped to white, or scaled to 0..out_max; halves go away from zero."""
    if out_max is None:
        return F.round(F.greatest(F.lit(0.0), F.least(v, F.lit(white)))).cast("int")
    return F.round(F.greatest(F.lit(0.0), F.least(v * out_max / white, F.lit(out_max)))).cast("int")
