"""Merges: aggregation across the aligned frames of a burst.

Inputs are pixels joined with frames' ref, scale and wn (see with_frames).  Each
merge is one shuffle by place (burst, y, x), which serves its windows over
channels and frames and its sums; blurs take one more, by block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import blocks, stencil

PIXEL = ("burst", "y", "x", "c")
MIN_WEIGHT, MIN_LINEAR = 0.08, 0.04


def with_frames(px: DataFrame, frames: DataFrame) -> DataFrame:
    """px with ref, scale and wn of each frame."""
    return px.join(blocks.few(frames.select("burst", "frame", "ref", "scale", "wn")), ["burst", "frame"])


def _by_place(px: DataFrame) -> DataFrame:
    """Dealt by burst, y and x, which all windows and sums here contain."""
    return px.repartition("burst", "y", "x")


def _is_ref() -> Column:
    return F.col("frame") == F.col("ref")


def _ref(v: str = "v") -> Column:
    return F.max(F.when(_is_ref(), F.col(v)))


def _top(v: str = "v") -> Column:
    return F.max(v).over(W.partitionBy("burst", "frame", "y", "x"))


def temporal_average(px: DataFrame) -> DataFrame:
    return px.groupBy(*PIXEL).agg(F.avg("v").alias("v"))


def temporal_average_weighted(px: DataFrame, white: float, black: float) -> DataFrame:
    """Comparisons weigh by exposure and by how dark their blurred value is; the reference weighs 1."""
    px = stencil.box_blur(px, 2, out="blur")
    ef = 1 / F.greatest(F.lit(1e-6), F.col("scale"))
    lum = F.greatest(F.lit(0.0), F.least((F.col("blur") - black) / max(1.0, white - black), F.lit(1.0)))
    t = F.greatest(F.lit(0.0), F.least((lum - 0.25) / 0.74, F.lit(1.0)))
    w = F.when(lum < 0.25, ef).otherwise(ef + (1 - ef) * t)
    w = F.greatest(F.lit(1.0), w) * F.greatest(F.lit(0.0), F.least(0.99 / 0.74 - lum / 0.74, F.lit(1.0)))
    w = F.when(_is_ref(), 1.0).otherwise(w)
    return px.withColumn("w", w).groupBy(*PIXEL).agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))


def temporal_median(px: DataFrame, clip: float | None) -> DataFrame:
    """Median of the reference and the comparisons that are not clipped in any channel; clipped reference values stay."""
    px = _by_place(px)
    gate = F.lit(True) if clip is None else _top() < clip * F.col("scale")
    kept = F.when(_is_ref() | F.col("ok"), F.col("v"))
    out = px.withColumn("ok", gate).groupBy(*PIXEL).agg(_ref().alias("r"), F.median(kept).alias("m"), F.count(kept).alias("n_kept"))
    keep = F.lit(False) if clip is None else F.col("r") >= clip
    return out.select(*PIXEL, F.when(keep, F.col("r")).otherwise(F.col("m")).alias("v"), "n_kept")


def expbracket_average(px: DataFrame, clip: float) -> DataFrame:
    px = _by_place(px)
    w = F.when(_is_ref(), 1.0).when(F.lit(clip > 0) & (_top() >= clip * F.col("scale")), 0.0).otherwise(F.col("wn"))
    return px.withColumn("w", w).groupBy(*PIXEL).agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))


def spatial(px: DataFrame, noise: float, rho: float, white: float, black: float, multi: bool, linear: bool = False, weighted: bool = False, block: int = 2, chroma: bool = False) -> DataFrame:
    """Robust average: comparisons weigh less the more their smoothed value differs from the reference's.

    One channel compares block means (linear: binomial blurs), several the largest
    difference of blurred channels.  Clipped comparisons weigh 0, highlights are judged more mildly.
    """
    high, clip = 0.92 * (white - black), 0.98 * (white - black)
    if linear:
        px = stencil.binomial16(px, out="guide")
    else:
        px = stencil.box_blur(px, 2, out="guide") if multi else stencil.block_mean(px, block)
    px = _by_place(px)
    cell = W.partitionBy(*PIXEL)
    px = px.withColumn("ref_guide", F.max(F.when(_is_ref(), F.col("guide"))).over(cell))
    d = F.abs(F.col("guide") - F.col("ref_guide"))
    if multi:
        pixel = W.partitionBy("burst", "frame", "y", "x")
        px = px.withColumn("r", F.max(F.when(_is_ref(), F.col("v"))).over(cell))
        px = px.withColumn("d", F.max(d).over(pixel)).withColumn("top", F.max("v").over(pixel)).withColumn("top_ref", F.max("r").over(pixel))
        clipped, bright = F.col("top") >= clip * F.col("scale"), (F.col("top") >= high) | (F.col("top_ref") >= high)
    else:
        px = px.withColumn("d", d)
        clipped, bright = F.col("v") / F.col("scale") >= clip, (F.col("guide") >= high) | (F.col("ref_guide") >= high)
    if linear:
        one = F.greatest(F.lit(0.0), F.least(1 - F.col("d") / max(1.0, noise / max(0.001, rho)), F.lit(1.0)))
        mild = F.greatest(F.lit(0.0), F.least(1 - F.col("d") / (2.5 * max(1.0, noise / max(0.001, rho))), F.lit(1.0)))
    else:
        near = lambda n: 1 / (1 + (F.col("d") / n) * (F.col("d") / n) * rho)
        one, mild = F.greatest(F.lit(MIN_WEIGHT), near(noise)), F.greatest(F.lit(MIN_WEIGHT), near(max(1.0, 2.5 * noise)))
    w = F.when(clipped, 0.0).when(bright, mild).otherwise(one)
    if chroma:
        pixel = W.partitionBy("burst", "frame", "y", "x")
        part = lambda g: sum(F.max(F.when(F.col("c") == c, F.col(g))).over(pixel) * k for c, k in ((0, 0.5), (1, -0.5), (2, -0.5), (3, 0.5)))
        px = px.withColumn("chi", F.abs(part("guide") - part("ref_guide")))
        limit = max(2.0, 0.35 * noise)
        least = MIN_LINEAR if linear else MIN_WEIGHT
        w = w * F.when(F.col("chi") <= limit, 1.0).otherwise(F.greatest(F.lit(least), 1 - F.greatest(F.lit(0.0), F.least((F.col("chi") - limit) / max(1.0, limit), F.lit(1.0)))))
    w = F.when(_is_ref(), 1.0).otherwise(w * F.col("wn") if weighted else w)
    return px.withColumn("w", w).groupBy(*PIXEL).agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))


def laplacian(px: DataFrame, tile: int) -> DataFrame:
    """Weighted mean of the low bands plus the strongest high band (the first in frame order, reference first)."""
    px = stencil.box_blur(px, max(1, tile // 16), out="low")
    w = F.when(_is_ref(), 1.0).otherwise(F.col("wn"))
    order = F.when(_is_ref(), -1).otherwise(F.col("frame"))
    px = px.withColumn("w", w).withColumn("high", F.col("v") - F.col("low"))
    best = F.max_by("high", F.struct(F.round(F.abs("high"), 9).alias("a"), (-order).alias("o")))
    return px.groupBy(*PIXEL).agg((F.sum(F.col("w") * F.col("low")) / F.sum("w") + best).alias("v"))
