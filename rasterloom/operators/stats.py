"""Frame statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stencil
from .reshape import KEY


def robustness(nr: float) -> float:
    return max(0.2, 0.12 * 1.3 ** (0.5 * (36 - int(nr + 0.5))) - 0.4529822)


def noise_floor(px: DataFrame, stride: int = 4) -> DataFrame:
    """RMS of the difference to a radius-2 box blur on a grid of cells; 8 at least."""
    d = F.col("v") - F.col("blur")
    on = (F.col("y") % stride == 0) & (F.col("x") % stride == 0)
    return stencil.box_blur(px, 2, out="blur").where(on).groupBy("burst", "frame").agg(F.greatest(F.lit(8.0), F.sqrt(F.avg(d * d))).alias("noise"))


def linear_noise(px: DataFrame, stride: int = 4) -> DataFrame:
    """Mean over a grid of pixels of the channels' summed distance to the binomial blur; 1 at least."""
    on = (F.col("y") % stride == 0) & (F.col("x") % stride == 0)
    each = stencil.binomial16(px, out="blur").where(on).groupBy(*KEY).agg(F.sum(F.abs(F.col("v") - F.col("blur"))).alias("d"))
    return each.groupBy("burst", "frame").agg(F.greatest(F.lit(1.0), F.avg("d")).alias("noise"))


def max_value(px: DataFrame) -> DataFrame:
    return px.groupBy("burst", "frame").agg(F.coalesce(F.max("v"), F.lit(0.0)).alias("max_v"))


def mean_positive(values: Column) -> Column:
    """Mean of an array's entries over 0; 0 if none."""
    some = F.filter(values, lambda x: x > 0)
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, x: a + x) / F.size(some)).otherwise(0.0)


def min_positive(values: Column) -> Column:
    return F.coalesce(F.array_min(F.filter(values, lambda x: x > 0)), F.lit(0.0))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean and largest absolute difference, differing cells and means of two frames of each burst (columns burst, y, x, c, v)."""
    both = a.withColumnRenamed("v", "va").join(b.withColumnRenamed("v", "vb"), ["burst", "y", "x", "c"])
    d = F.abs(F.col("va") - F.col("vb"))
    out = both.groupBy("burst").agg(F.avg(d).alias("mad"), F.max(d).alias("max_diff"), F.sum((d > 0).cast("long")).alias("n_diff"), F.avg("va").alias("mean_a"), F.avg("vb").alias("mean_b"))
    return out.withColumn("rel_mad", F.when(F.col("mean_a") != 0, F.col("mad") / F.col("mean_a")))


def channel_stats(px: DataFrame) -> DataFrame:
    var = F.avg(F.col("v") * F.col("v")) - F.avg("v") * F.avg("v")
    return px.groupBy("burst", "frame", "c").agg(F.min("v").alias("min_v"), F.max("v").alias("max_v"), F.avg("v").alias("mean_v"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std_v"))
