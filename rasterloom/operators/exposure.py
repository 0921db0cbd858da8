"""Exposure classification, reference choice and exposure scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BRACKETED, CHAINED = 1.4, 2.0


def classify(frames: DataFrame) -> DataFrame:
    """has_exposure, is_bracketed, needs_chained and the frames by rising EV of each burst; EV 0 is unknown."""
    known = F.when(F.col("ev") > 0, F.struct("ev", "frame"))
    out = frames.groupBy("burst").agg(F.min(F.when(F.col("ev") > 0, F.col("ev"))).alias("low"), F.max(F.when(F.col("ev") > 0, F.col("ev"))).alias("high"), F.array_sort(F.collect_list(known)).alias("exposure_order"), F.count(F.lit(1)).alias("n_frames"))
    over = lambda k: F.coalesce(F.col("high") > k * F.col("low"), F.lit(False))
    return out.select("burst", "n_frames", F.col("low").isNotNull().alias("has_exposure"), over(BRACKETED).alias("is_bracketed"), over(CHAINED).alias("needs_chained"), "exposure_order")


def select_reference(frames: DataFrame) -> DataFrame:
    """ref of each burst: the darkest frame if bracketed, else the middle one."""
    ordered = F.sort_array(F.collect_list("frame"))
    middle = frames.groupBy("burst").agg(ordered.alias("all"))
    return classify(frames).join(middle, "burst").select("burst", F.when(F.col("is_bracketed"), F.get("exposure_order", F.lit(0))["frame"]).otherwise(F.get("all", (F.size("all") / 2).cast("int"))).alias("ref"))


def scale_of(ref_ev: Column, ref_bias: Column, ev: Column, bias: Column) -> Column:
    return F.when((ref_ev > 0) & (ev > 0), ref_ev / ev * F.pow(F.lit(2.0), ref_bias - bias)).otherwise(F.lit(1.0))


def scales(frames: DataFrame, refs: DataFrame) -> DataFrame:
    """frames with ref, scale (to the reference's exposure) and wn = 1 / scale."""
    w = W.partitionBy("burst")
    at_ref = lambda c: F.max(F.when(F.col("frame") == F.col("ref"), F.col(c))).over(w)
    out = frames.join(refs, "burst").withColumn("ref_ev", at_ref("ev")).withColumn("ref_bias", at_ref("bias"))
    out = out.withColumn("scale", scale_of(F.col("ref_ev"), F.col("ref_bias"), F.col("ev"), F.col("bias")))
    return out.withColumn("wn", 1 / F.col("scale")).drop("ref_ev", "ref_bias")
