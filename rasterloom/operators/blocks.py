"""Blocks of cells with a border: one shuffle brings the cells that a stencil or a tile needs to one task.

A block holds BLOCK by BLOCK cells of one frame, so a task's memory does not grow
with the frame.  Frames are dense: where a block's border has no cells, the frame
ends.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

BLOCK, FEW = 64, 100_000


def few(df: DataFrame) -> DataFrame:
    """A table of frames or bursts for a join: broadcast if it has at most FEW rows, else left to the planner."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def block_range(low: Column, high: Column) -> Column:
    """Numbers of the blocks from that of a first cell to that of a last one, one row each; none lies before 0."""
    first = F.greatest(F.floor(low / BLOCK), F.lit(0)).cast("int")
    last = F.floor(high / BLOCK).cast("int")
    return F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>")))


def filtered(px: DataFrame, halo: int, kernel: Callable[[np.ndarray], np.ndarray], v: str = "v", out: str = "v") -> DataFrame:
    """px with out: kernel of v over each frame and channel, of which a cell reads at most halo cells around it."""
    kept = [f for f in px.schema.fields if f.name != out]
    schema = StructType([*kept]).add(out, DoubleType())
    names = [f.name for f in kept]
    dealt = px.withColumn("__v", F.col(v).cast("double")).withColumn("__by", block_range(F.col("y") - halo, F.col("y") + halo)).withColumn("__bx", block_range(F.col("x") - halo, F.col("x") + halo))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf.y.to_numpy(), pdf.x.to_numpy()
        y0, x0 = y.min(), x.min()
        image = np.zeros((y.max() - y0 + 1, x.max() - x0 + 1))
        image[y - y0, x - x0] = pdf["__v"]
        own = (y // BLOCK == pdf["__by"]) & (x // BLOCK == pdf["__bx"])
        got = pdf.loc[own, names].copy()
        got[out] = kernel(image)[y[own] - y0, x[own] - x0] if len(got) else np.zeros(0)
        return got

    return dealt.groupBy("burst", "frame", "c", "__by", "__bx").applyInPandas(one, schema)


def separable(weights: dict[int, float], renormalise: bool) -> Callable[[np.ndarray], np.ndarray]:
    """Weighted mean along both axes; past the edge the edge cell's value, or (renormalise) nothing."""

    def along(a: np.ndarray) -> np.ndarray:
        n = len(a)
        at = np.arange(n)
        total, weight = np.zeros_like(a), np.zeros(n)
        for k, w in weights.items():
            src = at + k
            inside = (src >= 0) & (src < n)
            if renormalise:
                total[inside] += w * a[src[inside]]
                weight[inside] += w
            else:
                total += w * a[src.clip(0, n - 1)]
                weight += w
        return total / weight[:, None]

    return lambda image: along(along(image).T).T


def box(r: int) -> Callable[[np.ndarray], np.ndarray]:
    """Mean of (2r+1)**2 cells, edges replicated."""

    def along(a: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(np.pad(a, ((r, r), (0, 0)), mode="edge"), 2 * r + 1, 0).sum(-1)

    return lambda image: along(along(image).T).T / (2 * r + 1) ** 2


def region(y: np.ndarray, x: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, int, int]:
    """(cells as an array, NaN where there are none; its first row and column)."""
    if not len(y):
        return np.full((0, 0), np.nan), 0, 0
    y0, x0 = int(y.min()), int(x.min())
    out = np.full((int(y.max()) - y0 + 1, int(x.max()) - x0 + 1), np.nan)
    out[y - y0, x - x0] = v
    return out, y0, x0


def cut(cells: tuple[np.ndarray, int, int], y: int, x: int, h: int, w: int) -> np.ndarray:
    """h by w cells of a region from (y, x) on; NaN outside."""
    a, y0, x0 = cells
    out = np.full((h, w), np.nan)
    top, left, bottom, right = max(y, y0), max(x, x0), min(y + h, y0 + a.shape[0]), min(x + w, x0 + a.shape[1])
    if bottom > top and right > left:
        out[top - y : bottom - y, left - x : right - x] = a[top - y0 : bottom - y0, left - x0 : right - x0]
    return out


def with_cells(asks: DataFrame, ref: DataFrame, cmp: DataFrame, reach: int) -> DataFrame:
    """Rows for the tasks of asks, by burst, frame, by and bx: role 0 the reference's cells of the block and `reach` more below and to the right, role 1 the frame's cells that the shifts (y - dy, x - dx) of these meet, role 2 the asks (ty, tx, dy, dx, ord) themselves, ord in v."""
    key = ("burst", "frame", "by", "bx")
    need = asks.groupBy(*key).agg(*(f(c).alias(f"{n}_{c}") for n, f in (("low", F.min), ("high", F.max)) for c in ("dy", "dx")))
    start = lambda b: F.col(b) * BLOCK
    end = lambda b: F.col(b) * BLOCK + BLOCK - 1 + reach
    at = lambda df: df.withColumn("cy", F.floor(F.col("y") / BLOCK).cast("int")).withColumn("cx", F.floor(F.col("x") / BLOCK).cast("int"))
    of_ref = need.select(*key, block_range(start("by"), end("by")).alias("cy")).withColumn("cx", block_range(start("bx"), end("bx")))
    of_cmp = need.select("*", block_range(start("by") - F.col("high_dy"), end("by") - F.col("low_dy")).alias("cy")).withColumn("cx", block_range(start("bx") - F.col("high_dx"), end("bx") - F.col("low_dx")))
    zero = F.lit(0)
    rows = lambda df, role: df.select(*key, F.lit(role).alias("role"), "y", "x", zero.alias("dy"), zero.alias("dx"), "v")
    refs = rows(of_ref.join(at(ref.select("burst", "y", "x", F.col("r").alias("v"))), ["burst", "cy", "cx"]), 0)
    cmps = rows(of_cmp.join(at(cmp), ["burst", "frame", "cy", "cx"]), 1)
    return refs.unionByName(cmps).unionByName(asks.select(*key, F.lit(2).alias("role"), F.col("ty").alias("y"), F.col("tx").alias("x"), "dy", "dx", F.col("ord").cast("double").alias("v")))
