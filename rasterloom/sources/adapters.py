"""Relational rasters: pixels(burst, frame, y, x, c, v) and frames(burst, frame, ev, bias, white, black)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Exposure value of each line number's frame (0: unknown), white and black level of the quantity scale.
FRAME_EV = (1.0, 0.25, 4.0, 1.0, 1.0, 1.25, 0.0)
WHITE, BLACK = 50.0, 2.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_pixels(embeddings: DataFrame, side: int = 8) -> DataFrame:
    """Each vector as a one-channel frame of its label's burst."""
    flat = embeddings.select(F.col("label").alias("burst"), F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("pos", "v"))
    return flat.select("burst", "frame", F.expr(f"int(pos div {side})").alias("y"), (F.col("pos") % side).alias("x"), F.lit(0).alias("c"), F.col("v").cast("double").alias("v"))


def lineitem_pixels(lineitem: DataFrame, width: int = 16, height: int = 16, planes: int = 1) -> DataFrame:
    """Line numbers as frames on a dense grid by order key: mean quantity (and price, discount, tax planes, scaled to whole numbers); holes are 0."""
    n = width * height
    measures = [F.sum("l_quantity"), F.sum(F.round(F.col("l_extendedprice") / 1000)), F.sum(F.round(F.col("l_discount") * 100)), F.sum(F.round(F.col("l_tax") * 100))][:planes]
    cells = lineitem.groupBy((F.col("l_linenumber") - 1).alias("frame"), (F.col("l_orderkey") % n).cast("int").alias("idx"))
    cells = cells.agg(*((m / F.count(F.lit(1))).alias(f"p{i}") for i, m in enumerate(measures)))
    grid = lineitem.sparkSession.range(n * len(FRAME_EV)).select((F.col("id") % n).cast("int").alias("idx"), F.expr(f"int(id div {n})").alias("frame"))
    dense = grid.join(cells, ["frame", "idx"], "left")
    long = dense.select("frame", "idx", F.posexplode(F.array(*(F.coalesce(f"p{i}", F.lit(0.0)) for i in range(planes)))).alias("c", "v"))
    return long.select(F.lit(0).alias("burst"), "frame", F.expr(f"int(idx div {width})").alias("y"), (F.col("idx") % width).alias("x"), "c", "v")


def frame_table(spark: SparkSession, ev: tuple[float, ...] = FRAME_EV, white: float = WHITE, black: float = BLACK, bias: tuple[float, ...] | None = None, burst: int = 0) -> DataFrame:
    rows = [(burst, i, e, (bias or (0.0,) * len(ev))[i], white, black) for i, e in enumerate(ev)]
    return spark.createDataFrame(rows, "burst int, frame int, ev double, bias double, white double, black double")
