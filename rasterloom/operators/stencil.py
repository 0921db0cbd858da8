"""Stencils and resampling: kernels over blocks with a border, and joins on computed coordinates."""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import blocks
from .reshape import KEY


def box_blur(px: DataFrame, r: int, v: str = "v", out: str = "v") -> DataFrame:
    """Mean of (2r+1)**2 cells, edges replicated."""
    if r <= 0:
        return px.withColumn(out, F.col(v))
    return blocks.filtered(px, r, blocks.box(r), v, out).withColumn(out, F.coalesce(out, F.lit(float("nan"))))  # pandas gives NaN as null


def large_blur(px: DataFrame, r: int, v: str = "v", out: str = "v") -> DataFrame:
    return box_blur(box_blur(px, r, v, "__l"), r, "__l", out).drop("__l")


def binomial5(px: DataFrame, v: str = "v", out: str = "v") -> DataFrame:
    """[1 4 6 4 1] / 16 along both axes, edges replicated."""
    return blocks.filtered(px, 2, blocks.separable({-2: 1, -1: 4, 0: 6, 1: 4, 2: 1}, False), v, out)


def binomial16(px: DataFrame, v: str = "v", out: str = "v", radius: int = 5) -> DataFrame:
    """Weights of the 32nd binomial row around its middle, cropped to the frame and renormalised."""
    return blocks.filtered(px, radius, blocks.separable({k: float(comb(32, 16 + k)) for k in range(-radius, radius + 1)}, True), v, out)


def block_mean(px: DataFrame, b: int, out: str = "guide") -> DataFrame:
    """Mean of channel 0 in each aligned block, beside each pixel."""
    w = W.partitionBy("burst", "frame", F.expr(f"y div {b}"), F.expr(f"x div {b}"))
    return px.withColumn(out, F.avg(F.when(F.col("c") == 0, F.col("v"))).over(w))


def downsample(px: DataFrame, k: int, width: int, height: int) -> DataFrame:
    """Mean of k by k cells; trailing cells beyond a whole block are dropped."""
    w, h = max(1, width // k), max(1, height // k)
    at = px.select("burst", "frame", F.expr(f"int(y div {k})").alias("y"), F.expr(f"int(x div {k})").alias("x"), "c", "v")
    return at.where((F.col("y") < h) & (F.col("x") < w)).groupBy(*KEY, "c").agg(F.avg("v").alias("v"))


def pyramid_sizes(width: int, height: int, tile: int) -> list[tuple[int, int]]:
    """(width, height) of each level, the finest first."""
    half = max(1, tile // 2)
    tiles = lambda w, h: 0 if w < half or h < half else (-(-w // half) - 1) * (-(-h // half) - 1)
    down = lambda s: (max(1, s[0] // 2), max(1, s[1] // 2))
    sizes = [(width, height)]
    if min(width, height) >= 2 * half and tiles(*down(sizes[0])) >= 4:
        sizes.append(down(sizes[0]))
        while True:
            prev, nxt = sizes[-1], down(sizes[-1])
            if min(prev) < 2 * half or min(nxt) < half or tiles(*prev) <= 8 or tiles(*nxt) < 4:
                break
            sizes.append(nxt)
    return sizes


def pyramid(px: DataFrame, width: int, height: int, tile: int) -> list[DataFrame]:
    """Levels of a gray burst: plain halving first, then halving after the 5-tap filter."""
    sizes = pyramid_sizes(width, height, tile)
    levels = [px]
    for i in range(1, len(sizes)):
        levels.append(downsample(levels[-1] if i == 1 else binomial5(levels[-1]), 2, *sizes[i - 1]))
    return levels


def warp_translate(px: DataFrame, dx: float, dy: float, width: int, height: int) -> DataFrame:
    """out[y, x] = px[round(y - dy), round(x - dx)], clamped to the frame: each source cell feeds the cells that read it."""
    at = px.select(*KEY, "c")
    clamp = lambda v, n: F.greatest(F.lit(0), F.least(F.round(v).cast("int"), F.lit(n - 1)))
    wanted = at.withColumn("sy", clamp(F.col("y") - dy, height)).withColumn("sx", clamp(F.col("x") - dx, width))
    src = px.select("burst", "frame", F.col("y").alias("sy"), F.col("x").alias("sx"), "c", "v")
    return wanted.join(src, ["burst", "frame", "sy", "sx", "c"]).select(*KEY, "c", "v")


def warp_aligned(px: DataFrame, field: DataFrame, spacing: int, width: int, height: int) -> DataFrame:
    """Blend of the four samples that the surrounding tiles' shifts point at; field(burst, frame, ty, tx, dx, dy)."""
    size = blocks.few(field.groupBy("burst", "frame").agg((F.max("tx") + 1).alias("ntx"), (F.max("ty") + 1).alias("nty")))
    at = _corners(px.select(*KEY, "c").join(size, ["burst", "frame"]), spacing).select(*KEY, "c", "k.*").join(field, ["burst", "frame", "ty", "tx"])
    clamp = lambda v, n: F.greatest(F.lit(0), F.least(v, F.lit(n - 1)))
    at = at.withColumn("sy", clamp(F.col("y") - F.col("dy"), height)).withColumn("sx", clamp(F.col("x") - F.col("dx"), width))
    src = px.select("burst", "frame", F.col("y").alias("sy"), F.col("x").alias("sx"), "c", "v")
    return at.join(src, ["burst", "frame", "sy", "sx", "c"]).groupBy(*KEY, "c").agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def tile_shift(at: DataFrame, field: DataFrame, spacing: int) -> DataFrame:
    """Shift at each cell (burst, frame, y, x): the bilinear blend of the four tiles around it, indexes clamped; sx and sy."""
    size = blocks.few(field.groupBy("burst", "frame").agg((F.max("tx") + 1).alias("ntx"), (F.max("ty") + 1).alias("nty")))
    corners = _corners(at.select(*KEY).distinct().join(size, ["burst", "frame"]), spacing)
    blend = lambda c: F.sum(F.col("w") * F.col(c))
    return corners.select(*KEY, "k.*").join(field, ["burst", "frame", "ty", "tx"]).groupBy(*KEY).agg(blend("dx").alias("sx"), blend("dy").alias("sy"))


def _corners(at: DataFrame, spacing: int) -> DataFrame:
    """A row k (ty, tx, w) for each of the four tiles around a cell, with its bilinear weight."""
    for axis in ("x", "y"):
        f = (F.col(axis) + 0.5) / spacing - 1
        at = at.withColumn(f"{axis}0", F.floor(f).cast("int")).withColumn(f"{axis}t", f - F.floor(f))
    inside = lambda v, n: F.greatest(F.lit(0), F.least(v, n - 1))
    corners = F.array(*(F.struct(inside(F.col("y0") + j, F.col("nty")).alias("ty"), inside(F.col("x0") + i, F.col("ntx")).alias("tx"), ((F.col("yt") if j else 1 - F.col("yt")) * (F.col("xt") if i else 1 - F.col("xt"))).alias("w")) for j in (0, 1) for i in (0, 1)))
    return at.withColumn("k", F.explode(corners))
