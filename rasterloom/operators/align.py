"""Tile motion: candidate shifts, costs and coarse-to-fine search.

A shift (dx, dy) compares ref[y, x] with cmp[y - dy, x - dx].  Ties go to the
first shift in dy-major order.  px is a gray burst; refs(burst, ref) names each
burst's reference.  A search runs block by block: one join brings a block's cells
of the reference and the cells that its shifts meet to a task, which tries all
candidates in arrays.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import checkpointed
from . import blocks, stencil

OUTSIDE = 65504.0


def _sides(px: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = px.join(blocks.few(refs), "burst")
    ref = both.where(F.col("frame") == F.col("ref")).select("burst", "y", "x", F.col("v").alias("r"))
    return ref, both.where(F.col("frame") != F.col("ref")).select("burst", "frame", "y", "x", "v")


def _square(radius: int) -> Column:
    """All shifts within radius, as structs (oy, ox)."""
    return F.array(*(F.struct(F.lit(y).alias("oy"), F.lit(x).alias("ox")) for y in range(-radius, radius + 1) for x in range(-radius, radius + 1)))


def _millionths(cost: np.ndarray | float) -> np.ndarray | float:
    """Costs tie by this; halves, which are frequent and which sums in another order miss, lie off its steps."""
    return np.floor(cost * 1e6 + 0.53)


def _first_best(cost: str) -> Column:
    """Cheapest candidate; costs that agree to six places tie, but the unrounded cost is returned."""
    y = F.col(cost) * 1e6 + 0.53
    key = F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)
    return F.min(F.struct(key.alias("key"), "dy", "dx", F.col(cost).alias("cost")))


def sparse_sad(px: DataFrame, refs: DataFrame, radius: int, width: int, height: int, step: int = 1, start: DataFrame | None = None) -> DataFrame:
    """Best whole-frame shift of each frame within radius of its start (burst, frame, dx, dy; else zero) by the mean absolute difference over the common area, on a grid of step.  Frames whose shifts leave no common cell have no row."""
    ref, cmp = _sides(px, refs)
    if start is None:
        start = cmp.select("burst", "frame").distinct().select("*", F.lit(0).alias("dx"), F.lit(0).alias("dy"))
    grid = start.select("burst", "frame", F.col("dy").cast("int").alias("y0"), F.col("dx").cast("int").alias("x0"), blocks.block_range(F.lit(0), F.lit(height - 1)).alias("by")).withColumn("bx", blocks.block_range(F.lit(0), F.lit(width - 1)))
    ends = F.explode(F.array(*(F.struct(F.lit(-1).alias("ty"), F.lit(-1).alias("tx"), (F.col("y0") + k).alias("dy"), (F.col("x0") + k).alias("dx")) for k in (-radius, radius))))
    asks = grid.select("burst", "frame", "by", "bx", ends.alias("k")).select("burst", "frame", "by", "bx", "k.*", F.lit(0).alias("ord"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        side = lambda r: blocks.region(*(pdf.loc[pdf.role == r, c].to_numpy() for c in ("y", "x", "v")))
        own, other, ask = side(0), side(1), pdf[pdf.role == 2]
        a, y0, x0 = own
        out = []
        for dy in range(int(ask.dy.min()), int(ask.dy.max()) + 1):
            ys = np.arange(y0, y0 + a.shape[0])
            ys = ys[(ys >= abs(dy)) & (ys < height - abs(dy)) & ((ys - abs(dy)) % step == 0)]
            for dx in range(int(ask.dx.min()), int(ask.dx.max()) + 1) if len(ys) else ():
                xs = np.arange(x0, x0 + a.shape[1])
                xs = xs[(xs >= abs(dx)) & (xs < width - abs(dx)) & ((xs - abs(dx)) % step == 0)]
                if len(xs):
                    met = other[0][np.ix_(ys - dy - other[1], xs - dx - other[2])]
                    out.append((dy, dx, float(np.abs(a[np.ix_(ys - y0, xs - x0)] - met).sum()), len(ys) * len(xs)))
        got = pd.DataFrame(out, columns=["dy", "dx", "total", "n"])
        got.insert(0, "frame", pdf.frame.iloc[0])
        got.insert(0, "burst", pdf.burst.iloc[0])
        return got

    parts = blocks.with_cells(asks, ref, cmp, 0).groupBy("burst", "frame", "by", "bx").applyInPandas(one, f"burst {dict(px.dtypes)['burst']}, frame {dict(px.dtypes)['frame']}, dy int, dx int, total double, n long")
    cost = parts.groupBy("burst", "frame", "dy", "dx").agg((F.sum("total") / F.sum("n")).alias("sad"))
    return cost.groupBy("burst", "frame").agg(_first_best("sad").alias("b")).select("burst", "frame", "b.dx", "b.dy", F.col("b.cost").alias("sad"))


def global_search(px: DataFrame, refs: DataFrame, tile: int, width: int, height: int) -> DataFrame:
    """Whole-frame shift of each frame, coarse to fine over the pyramid: burst, frame, dx, dy, sad, confidence.  A level without a common cell keeps the shift; a null sad has confidence 0."""
    levels, sizes = stencil.pyramid(px, width, height, tile), stencil.pyramid_sizes(width, height, tile)
    best = zero_field(px, refs, (1, 1)).select("burst", "frame", "dx", "dy")
    for level in reversed(range(len(levels))):
        if level < len(levels) - 1:
            scale = sizes[level][0] // sizes[level + 1][0]
            best = best.select("burst", "frame", (F.col("dx") * scale).alias("dx"), (F.col("dy") * scale).alias("dy"))
        radius = max(3, max(sizes[level]) >> (2 + len(levels) - level))
        found = sparse_sad(levels[level], refs, radius, *sizes[level], max(1, 16 >> (level + 1)), best)
        found = found.select("burst", "frame", F.col("dx").alias("fx"), F.col("dy").alias("fy"), "sad")
        best = checkpointed(best.join(found, ["burst", "frame"], "left").select("burst", "frame", F.coalesce("fx", "dx").alias("dx"), F.coalesce("fy", "dy").alias("dy"), "sad"))
    return best.withColumn("confidence", F.coalesce(1 / (1 + F.col("sad")), F.lit(0.0)))


def _tiles(px: DataFrame, refs: DataFrame, candidates: DataFrame, tile: int, stride: int, squared: bool, choose: Callable, columns: str) -> DataFrame:
    """choose(shifts (n, 2) as dy and dx, costs) of each tile with candidates (burst, frame, ty, tx, dy, dx, by ord if they have one, else dy-major): summed difference, cells outside cost OUTSIDE."""
    ref, cmp = _sides(px, refs)
    first = lambda t: F.floor(F.col(t) * stride / blocks.BLOCK).cast("int")
    own_order = F.min("ord" if "ord" in candidates.columns else F.lit(0)).alias("ord")
    asks = candidates.groupBy("burst", "frame", "ty", "tx", "dy", "dx").agg(own_order).withColumn("by", first("ty")).withColumn("bx", first("tx"))
    names = [c.split()[0] for c in columns.split(", ")]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        side = lambda r: blocks.region(*(pdf.loc[pdf.role == r, c].to_numpy() for c in ("y", "x", "v")))
        own, other, ask = side(0), side(1), pdf[pdf.role == 2].sort_values(["y", "x", "v", "dy", "dx"])
        out = []
        for (ty, tx), shifts in ask.groupby(["y", "x"]):
            shifts = shifts[["dy", "dx"]].to_numpy()
            r = blocks.cut(own, ty * stride, tx * stride, tile, tile)
            inside = ~np.isnan(r)
            low, high = shifts.min(0), shifts.max(0)
            m = blocks.cut(other, ty * stride - high[0], tx * stride - high[1], tile + high[0] - low[0], tile + high[1] - low[1])
            costs = np.empty(len(shifts))
            for i, (dy, dx) in enumerate(shifts.tolist()):
                at = m[high[0] - dy : high[0] - dy + tile, high[1] - dx : high[1] - dx + tile]
                d = np.abs(r[inside] - at[inside])
                d[np.isnan(d)] = OUTSIDE
                costs[i] = (d * d if squared else d).sum()
            out.append((ty, tx, *choose(shifts, costs)))
        got = pd.DataFrame(out, columns=names)
        got.insert(0, "frame", pdf.frame.iloc[0])
        got.insert(0, "burst", pdf.burst.iloc[0])
        return got

    kinds = dict(px.dtypes)
    return blocks.with_cells(asks, ref, cmp, tile - 1).groupBy("burst", "frame", "by", "bx").applyInPandas(one, f"burst {kinds['burst']}, frame {kinds['frame']}, {columns}")


def tile_search(px: DataFrame, refs: DataFrame, candidates: DataFrame, tile: int, stride: int, grid: tuple[int, int], squared: bool = False) -> DataFrame:
    """Cheapest of the candidate shifts of each tile; costs that agree to six places tie."""

    def cheapest(shifts: np.ndarray, costs: np.ndarray) -> tuple[int, int, float]:
        i = int(np.argmin(_millionths(costs)))
        return shifts[i, 1], shifts[i, 0], costs[i]

    inside = (F.col("ty") < grid[1]) & (F.col("tx") < grid[0])
    return _tiles(px, refs, candidates.where(inside), tile, stride, squared, cheapest, "ty int, tx int, dx int, dy int, cost double")


def tile_average(px: DataFrame, refs: DataFrame, candidates: DataFrame, tile: int, stride: int, squared: bool = False) -> DataFrame:
    """Mean of the candidate shifts of each tile, weighted by the inverse of their squared costs (plus 1e-8), rounded away from zero at halves."""

    def mean(shifts: np.ndarray, costs: np.ndarray) -> tuple[int, int]:
        w = 1 / (costs * costs + 1e-8)
        at = (shifts * w[:, None]).sum(0) / w.sum()
        return tuple(int(v) for v in (np.sign(at) * np.floor(np.abs(at) + 0.5))[::-1])

    return _tiles(px, refs, candidates, tile, stride, squared, mean, "ty int, tx int, dx int, dy int")


def around(field: DataFrame, radius: int) -> DataFrame:
    """Candidates within radius of each tile's shift."""
    return field.withColumn("o", F.explode(_square(radius))).select("burst", "frame", "ty", "tx", (F.col("dy") + F.col("o.oy")).alias("dy"), (F.col("dx") + F.col("o.ox")).alias("dx"))


def dense_grid(width: int, height: int, tile: int) -> tuple[int, int]:
    half = tile // 2
    return max(1, -(-width // half) - 1), max(1, -(-height // half) - 1)


def zero_field(px: DataFrame, refs: DataFrame, grid: tuple[int, int]) -> DataFrame:
    frames = px.select("burst", "frame").distinct().join(blocks.few(refs), "burst").where("frame <> ref")
    return frames.select("burst", "frame", F.explode(F.sequence(F.lit(0), F.lit(grid[1] - 1))).alias("ty")).select("*", F.explode(F.sequence(F.lit(0), F.lit(grid[0] - 1))).alias("tx"), F.lit(0).alias("dx"), F.lit(0).alias("dy"))


def propagate(field: DataFrame, grid: tuple[int, int], parent: tuple[int, int], ratio: int = 2) -> DataFrame:
    """Each finer tile takes its parent's shift, scaled."""
    fine = field.select("burst", "frame").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(grid[1] - 1))).alias("ty")).select("*", F.explode(F.sequence(F.lit(0), F.lit(grid[0] - 1))).alias("tx"))
    fine = fine.withColumn("py", F.least(F.expr(f"int(ty div {ratio})"), F.lit(parent[1] - 1))).withColumn("px", F.least(F.expr(f"int(tx div {ratio})"), F.lit(parent[0] - 1)))
    up = field.select("burst", "frame", F.col("ty").alias("py"), F.col("tx").alias("px"), (F.col("dx") * ratio).alias("dx"), (F.col("dy") * ratio).alias("dy"))
    return fine.join(up, ["burst", "frame", "py", "px"]).select("burst", "frame", "ty", "tx", "dx", "dy")


def neighbour_candidates(field: DataFrame, grid: tuple[int, int]) -> DataFrame:
    """In this order: own shift and those of the neighbours in the row and the column on the far side of the parent (even: before, odd: after; clamped)."""
    side = lambda t, n: F.greatest(F.lit(0), F.least(F.when(F.col(t) % 2 == 0, F.col(t) - 1).otherwise(F.col(t) + 1), F.lit(n - 1)))
    near = [(F.col("ty"), F.col("tx")), (F.col("ty"), side("tx", grid[0])), (side("ty", grid[1]), F.col("tx"))]
    asks = field.select("burst", "frame", "ty", "tx", F.explode(F.array(*(F.struct(F.lit(i).alias("ord"), y.alias("ny"), x.alias("nx")) for i, (y, x) in enumerate(near)))).alias("k")).select("burst", "frame", "ty", "tx", "k.*")
    return asks.join(field.select("burst", "frame", F.col("ty").alias("ny"), F.col("tx").alias("nx"), "dx", "dy"), ["burst", "frame", "ny", "nx"]).select("burst", "frame", "ty", "tx", "dy", "dx", "ord")


def cached_pyramid(px: DataFrame, width: int, height: int, tile: int) -> list[DataFrame]:
    """Pyramid levels of a gray burst, each written once, for several searches against the same frames."""
    return [checkpointed(x) for x in stencil.pyramid(px, width, height, tile)]


def dense_field(px: DataFrame, refs: DataFrame, tile: int, width: int, height: int, frequency: bool = False, weighted: bool = False, levels: list[DataFrame] | None = None) -> DataFrame:
    """Shift of each half-overlapping tile, coarse to fine from zero; squared cost above the finest level.  frequency: absolute cost and no neighbour correction; weighted: means over the candidates instead of the cheapest; levels: cached_pyramid()."""
    levels, sizes = levels or stencil.pyramid(px, width, height, tile), stencil.pyramid_sizes(width, height, tile)
    field = parent = None

    def best(level: int, asks: DataFrame, grid: tuple[int, int], squared: bool) -> DataFrame:
        if weighted:
            return tile_average(levels[level], refs, asks, tile, tile // 2, squared)
        return tile_search(levels[level], refs, asks, tile, tile // 2, grid, squared).drop("cost")

    for level in reversed(range(len(levels))):
        grid = dense_grid(*sizes[level], tile)
        squared = level > 0 and not frequency
        if field is None:
            field = zero_field(px, refs, grid)
        else:
            field = propagate(field, grid, parent, sizes[level][0] // sizes[level + 1][0])
            if not frequency:
                field = best(level, neighbour_candidates(field, grid), grid, squared)
        field = checkpointed(best(level, around(field, 3), grid, squared).select("burst", "frame", "ty", "tx", "dx", "dy"))
        parent = grid
    return field


def fourier_shift(tiles: DataFrame) -> DataFrame:
    """Sub-pixel shift of each pair of equal tiles (id, h, w, ref and cmp as rows of values): of 6x6 within half a cell that under which cmp's spectrum comes nearest to ref's, the first of those that agree to six places; sx, sy, confidence."""

    def run(batches):
        for b in batches:
            out = []
            for h, w, ref, cmp in zip(b.h, b.w, b.ref, b.cmp, strict=True):
                r, c = (np.fft.fft2(np.asarray(x, float).reshape(h, w)) for x in (ref, cmp))
                fy, fx = np.arange(h)[:, None] / h, np.arange(w)[None, :] / w
                best = None
                for sy in (np.arange(6) - 2.5) / 6:
                    for sx in (np.arange(6) - 2.5) / 6:
                        diff = (np.abs(r - c * np.exp(2j * np.pi * (fx * sx + fy * sy))) ** 2).sum()
                        if best is None or _millionths(diff) < _millionths(best[0]):
                            best = (diff, sx, sy)
                out.append((best[1], best[2], 1 / (1 + best[0] / (h * w))))
            got = pd.DataFrame(out, columns=["sx", "sy", "confidence"])
            got.insert(0, "id", b.id.to_numpy())
            yield got

    found = tiles.select("id", "h", "w", "ref", "cmp").mapInPandas(run, f"id {dict(tiles.dtypes)['id']}, sx double, sy double, confidence double")
    return found.withColumn("confidence", F.coalesce("confidence", F.lit(float("nan"))))  # pandas gives NaN as null


def smooth_field(field: DataFrame) -> DataFrame:
    """Upper median of each axis over the 3x3 neighbours that exist."""
    near = field.withColumn("o", F.explode(_square(1))).select("burst", "frame", (F.col("ty") + F.col("o.oy")).alias("ty"), (F.col("tx") + F.col("o.ox")).alias("tx"), "dx", "dy")
    upper = lambda c: F.element_at(F.array_sort(F.collect_list(c)), (F.floor(F.count(F.lit(1)) / 2) + 1).cast("int"))  # noqa: E731  at most nine
    return near.groupBy("burst", "frame", "ty", "tx").agg(upper("dx").alias("dx"), upper("dy").alias("dy")).join(field.select("burst", "frame", "ty", "tx"), ["burst", "frame", "ty", "tx"])


def skip(px: DataFrame, refs: DataFrame) -> DataFrame:
    """No motion at all."""
    return zero_field(px, refs, (1, 1))


def standard_field(px: DataFrame, refs: DataFrame, tile: int, width: int, height: int, search: int = 64, seeds: DataFrame | None = None) -> DataFrame:
    """Tiles without overlap, each searched around the mean of the frame's seed (burst, frame, dx, dy; else zero) and the left and upper tiles' shifts.  The recursion is sequential, so a frame is one task."""
    radius, nx, ny = min(3, max(1, search // 16)), -(-width // tile), -(-height // tile)
    half = lambda a, b: int((a + b) / 2)  # noqa: E731  towards zero
    ref, cmp = _sides(px, refs)
    if seeds is None:
        cmp = cmp.withColumn("seed_x", F.lit(0)).withColumn("seed_y", F.lit(0))
    else:
        cmp = cmp.join(seeds.select("burst", "frame", F.col("dx").alias("seed_x"), F.col("dy").alias("seed_y")), ["burst", "frame"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = np.zeros((height, width)), np.zeros((height, width))
        a[pdf.y, pdf.x], b[pdf.y, pdf.x] = pdf.r, pdf.v
        seed = int(pdf.seed_y.iloc[0]), int(pdf.seed_x.iloc[0])
        out = np.zeros((ny, nx, 2), int)
        for ty in range(ny):
            for tx in range(nx):
                dy, dx = seed
                if tx:
                    dy, dx = half(dy, out[ty, tx - 1, 0]), half(dx, out[ty, tx - 1, 1])
                if ty:
                    dy, dx = half(dy, out[ty - 1, tx, 0]), half(dx, out[ty - 1, tx, 1])
                ys, xs = np.mgrid[ty * tile : min(height, (ty + 1) * tile), tx * tile : min(width, (tx + 1) * tile)]
                best = None
                for oy in range(-radius, radius + 1):
                    for ox in range(-radius, radius + 1):
                        sy, sx = ys - dy - oy, xs - dx - ox
                        inside = (sy >= 0) & (sy < height) & (sx >= 0) & (sx < width)
                        cost = round(np.abs(a[ys, xs] - b[sy.clip(0, height - 1), sx.clip(0, width - 1)])[inside].sum() + OUTSIDE * (~inside).sum(), 6)
                        if best is None or cost < best[0]:
                            best = (cost, dy + oy, dx + ox)
                out[ty, tx] = best[1:]
        g = np.indices((ny, nx))
        return pd.DataFrame({"burst": pdf.burst.iloc[0], "frame": pdf.frame.iloc[0], "ty": g[0].ravel(), "tx": g[1].ravel(), "dx": out[..., 1].ravel(), "dy": out[..., 0].ravel()})

    return cmp.join(ref, ["burst", "y", "x"]).groupBy("burst", "frame").applyInPandas(one, "burst int, frame int, ty int, tx int, dx int, dy int")


def chained_order(order: list[tuple[float, int]], ref: int, frames: list[int]) -> list[tuple[int, int]]:
    """(frame, the frame to align it to): outwards from the reference by exposure; frames without exposure to the reference."""
    by_ev = [f for _, f in order]
    if ref not in by_ev:
        return [(f, ref) for f in frames if f != ref]
    at = by_ev.index(ref)
    out = [(by_ev[i], by_ev[i - 1]) for i in range(at + 1, len(by_ev))] + [(by_ev[i], by_ev[i + 1]) for i in range(at - 1, -1, -1)]
    return out + [(f, ref) for f in frames if f not in by_ev]
