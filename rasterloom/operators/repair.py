"""Hot-pixel repair and highlight recovery."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..lineage import checkpointed
from . import blocks
from .reshape import KEY


def _neighbours(step: int, diagonal: float, axis: float):
    """Kernel: weighted mean of the 8 neighbours `step` cells away; NaN where one is outside."""

    def kernel(a: np.ndarray) -> np.ndarray:
        p = np.pad(a, step, constant_values=np.nan)
        h, w = a.shape
        at = lambda dy, dx: p[step + dy : step + dy + h, step + dx : step + dx + w]
        total = axis * (at(0, -step) + at(0, step) + at(-step, 0) + at(step, 0))
        if diagonal:
            total = total + diagonal * (at(-step, -step) + at(-step, step) + at(step, -step) + at(step, step))
        return total / (4 * (diagonal + axis))

    return kernel


def hot_pixels(px: DataFrame, black: float | list[float], step: int = 2, phases: int = 1) -> DataFrame:
    """(burst, y, x, c, w) weights of hot pixels in the mean frame; a pixel with two flagged channels has none.

    A mosaic of one channel has phases: the mean level is that of the cell's place
    in the pattern.  black is one level, or one for each channel (or phase).
    """
    mean = px.groupBy("burst", "y", "x", "c").agg(F.avg("v").alias("v")).withColumn("frame", F.lit(0))
    mean = mean.withColumn("phase", F.col("y") % phases * phases + F.col("x") % phases)
    mean = checkpointed(blocks.filtered(mean, step, _neighbours(step, 1, 2), out="around"))
    level = blocks.few(mean.groupBy("burst", "c", "phase").agg(F.avg("v").alias("level")))
    levels = black if isinstance(black, (list, tuple)) else [black]
    own = F.lit(float(levels[0])) if len(levels) == 1 else F.element_at(F.array(*(F.lit(float(b)) for b in levels)), F.least(F.col("phase") if phases > 1 else F.col("c"), F.lit(len(levels) - 1)) + 1)
    mean = mean.join(level, ["burst", "c", "phase"])
    ratio = F.greatest(F.lit(1.0), F.col("v") - own) / F.greatest(F.lit(1.0), F.col("around") - own)
    inside = F.col("around").isNotNull() & ~F.isnan("around")  # pandas gives NaN as null
    hot = inside & (ratio >= 2) & (F.col("v") >= 2 * F.col("level"))
    w = F.when(hot, F.greatest(F.lit(0.0), F.least(0.5 * F.least(F.lit(2.0), ratio - 2), F.lit(1.0)))).otherwise(0.0)
    mean = mean.withColumn("w", w)
    flagged = F.sum((F.col("w") > 0.001).cast("int")).over(W.partitionBy("burst", "y", "x"))
    return mean.withColumn("w", F.when(flagged >= 2, 0.0).otherwise(F.col("w"))).select("burst", "y", "x", "c", "w")


def repair_hot_pixels(px: DataFrame, weights: DataFrame, step: int = 2) -> DataFrame:
    """Blend each flagged pixel of each frame with the mean of its four uncorrected axis neighbours."""
    out = blocks.filtered(px, step, _neighbours(step, 0, 1), out="near").join(weights, ["burst", "y", "x", "c"])
    return out.select(*KEY, "c", F.when(F.col("w") > 0.001, F.col("w") * F.col("near") + (1 - F.col("w")) * F.col("v")).otherwise(F.col("v")).alias("v"))


def green_blend(v: Column, estimate: Column, span: float) -> Column:
    t = F.greatest(F.lit(0.0), F.least(1 - v / span, F.lit(0.2)))
    w = 0.9 - 4.5 * t
    return w * F.greatest(estimate, v) + (1 - w) * v


def _wide(px: DataFrame, channels: int) -> DataFrame:
    return px.groupBy(*KEY).agg(*(F.max(F.when(F.col("c") == c, F.col("v"))).alias(f"c{c}") for c in range(channels)))


def _long(wide: DataFrame, channels: int) -> DataFrame:
    long = wide.select(*KEY, F.posexplode(F.array(*(F.col(f"c{c}") for c in range(channels)))).alias("c", "v"))
    return long.where("v IS NOT NULL")  # the last row or column of a mosaic may lack some of the planes


def recover_linear(px: DataFrame, span: float, f_r: float, f_b: float) -> DataFrame:
    """Three planes: bright greens rise to the mean of the scaled red and blue if one of these is saturated."""
    g, r, b = F.col("c1"), F.col("c0"), F.col("c2")
    hit = (g / span > 0.8) & ((r / span > 0.99 * f_r) | (b / span > 0.99 * f_b))
    wide = _wide(px, 3).withColumn("c1", F.when(hit, green_blend(g, (r / f_r + b / f_b) / 2, span)).otherwise(g))
    return _long(wide, 3)


def recover_bayer(px: DataFrame, span: float, f_r: float, f_b: float, pattern: tuple[int, ...] = (0, 1, 1, 2)) -> DataFrame:
    """Four planes of a 2x2 mosaic (0 red, 1 green, 2 blue): greens take the partners in their row and column, here and in the adjacent super-pixel."""
    wide = _wide(px, 4)
    row, col = W.partitionBy("burst", "frame", "y").orderBy("x"), W.partitionBy("burst", "frame", "x").orderBy("y")
    factor = {0: f_r, 2: f_b}
    new = {}
    for c in (i for i, colour in enumerate(pattern) if colour == 1):
        gy, gx = divmod(c, 2)
        h, v = 2 * gy + 1 - gx, 2 * (1 - gy) + gx
        far_h = F.lead(f"c{h}").over(row) if gx == 1 else F.lag(f"c{h}").over(row)
        far_v = F.lag(f"c{v}").over(col) if gy == 0 else F.lead(f"c{v}").over(col)
        f_h, f_v = factor[pattern[h]], factor[pattern[v]]
        partners = [(F.col(f"c{h}"), f_h), (far_h, f_h), (F.col(f"c{v}"), f_v), (far_v, f_v)]
        count = sum(p.isNotNull().cast("int") for p, _ in partners)
        estimate = sum(F.coalesce(p, F.lit(0.0)) / f for p, f in partners) / count
        hit = F.greatest(*(F.coalesce(p, F.lit(0.0)) / span / f for p, f in partners)) > 0.99
        g = F.col(f"c{c}")
        new[f"n{c}"] = F.when((g / span > 0.8) & hit, green_blend(g, estimate, span)).otherwise(g)
    out = wide.withColumns(new).select(*KEY, *(F.col(f"n{c}").alias(f"c{c}") if pattern[c] == 1 else F.col(f"c{c}") for c in range(4)))
    return _long(out, 4)


def recover_mosaic(px: DataFrame, span: float, f_r: float, f_b: float, pattern: tuple[int, ...]) -> DataFrame:
    """Any mosaic: greens take the mean of all scaled reds and blues of their super-pixel."""
    colour = F.element_at(F.array(*map(F.lit, pattern)), F.col("c") + 1)
    other = F.when(colour == 0, F.col("v") / f_r).when(colour == 2, F.col("v") / f_b)
    w = W.partitionBy(*KEY)
    out = px.withColumn("e", F.avg(other).over(w)).withColumn("m", F.max(other).over(w))
    hit = (colour == 1) & (F.col("v") / span > 0.8) & (F.col("m") / span > 0.99)
    return out.select(*KEY, "c", F.when(hit, green_blend(F.col("v"), F.col("e"), span)).otherwise(F.col("v")).alias("v"))
