"""Reshapes, element-wise maps and checks of pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("burst", "frame", "y", "x")


def mosaic_to_planes(px: DataFrame, period: int) -> DataFrame:
    """One-channel mosaic to period**2 planes."""
    return px.select("burst", "frame", F.expr(f"int(y div {period})").alias("y"), F.expr(f"int(x div {period})").alias("x"), (F.col("y") % period * period + F.col("x") % period).alias("c"), "v")


def planes_to_mosaic(px: DataFrame, period: int, width: int, height: int) -> DataFrame:
    """Inverse of mosaic_to_planes, cropped to width and height."""
    out = px.select("burst", "frame", F.expr(f"int(y * {period} + c div {period})").alias("y"), F.expr(f"int(x * {period} + c % {period})").alias("x"), F.lit(0).alias("c"), "v")
    return out.where((F.col("y") < height) & (F.col("x") < width))


def to_gray(px: DataFrame) -> DataFrame:
    return px.groupBy(*KEY).agg(F.avg("v").alias("v")).select(*KEY, F.lit(0).alias("c"), "v")


def gamma(v: Column, g: float, white: float) -> Column:
    if abs(g - 1) < 0.001 or white <= 0:
        return v
    return F.when(v <= 0, 0.0).when(v >= white, F.lit(white)).otherwise(F.pow(F.lit(white), F.lit(1 - g)) * F.pow(v, F.lit(g)))


def gray_gamma(px: DataFrame, g: float, white: float) -> DataFrame:
    return to_gray(px).withColumn("v", gamma(F.col("v"), g, white))


def normalize(px: DataFrame, frames: DataFrame) -> DataFrame:
    """Subtract the mean black (if over 1), then scale frames to the reference's exposure; frames has ref, scale and black."""
    from .blocks import few as small

    few = small(frames.select("burst", "frame", "ref", "scale", "black"))
    v = F.when(F.col("black") > 1, F.col("v") - F.col("black")).otherwise(F.col("v"))
    scaled = F.when((F.col("frame") != F.col("ref")) & (F.abs(F.col("scale") - 1) > 0.001), v * F.col("scale")).otherwise(v)
    return px.join(few, ["burst", "frame"]).select(*KEY, "c", scaled.alias("v"))


def snap_to_period(v: Column, period: int) -> Column:
    """Multiple of period, towards zero."""
    return (v / period).cast("int") * period


def check_compatible(px: DataFrame) -> DataFrame:
    """px, or an error if the frames of a burst differ in size or channels."""
    size = px.groupBy("burst", "frame").agg(F.max("y").alias("h"), F.max("x").alias("w"), F.max("c").alias("n"))
    bad = size.groupBy("burst").agg(F.countDistinct("h", "w", "n").alias("k")).where("k > 1").limit(1).count()
    if bad:
        raise ValueError("frames of a burst differ in size or channels")
    return px
