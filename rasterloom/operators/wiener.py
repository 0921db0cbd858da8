"""Frequency-domain merge of 8x8 tiles.

Tiles lie at every fourth cell and overlap-add under a raised-cosine window; a
comparison's spectrum is shifted by the sub-pixel phase that suits the reference
best and replaced by the reference's where they differ by more than the noise.

A tile needs only the cells around it, so a burst is cut into blocks of BLOCK by
BLOCK cells: each cell goes to the blocks that begin a tile which reads it, a task
takes one block of one burst at a time, all its tiles in one array, and the
tiles' overlapping results are added up by cell.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE, STRIDE, BLOCK = 8, 4, 32
# Gain of each bin's distance from the mean.
SHARPEN = np.array([0, 0.02, 0.04, 0.08, 0.04, 0.08, 0.04, 0.02])
#: Offsets (y, x) of the passes of the robust merge.
PASSES = ((0, 0), (0, STRIDE), (STRIDE, 0), (STRIDE, STRIDE))


def raised_cosine(n: int, swing: float = 0.5) -> np.ndarray:
    return np.ones(1) if n <= 1 else 0.5 - swing * np.cos(2 * np.pi * (np.arange(n) + 0.5) / n)


def noise_terms(nr: float) -> tuple[float, float, float]:
    """(rev, read noise, robustness norm) of a noise-reduction strength."""
    rev = 0.5 * (26.5 - int(nr + 0.5))
    return rev, (2.0 ** (10 - rev)) ** 1.6, 2.0 ** (7.5 - rev)


def best_phase(ref: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """Spectra (tiles, h, w, c) of comp, each under the sub-pixel shift, of 7x7 within half a cell, that comes nearest to ref; bins count from 0."""
    h, w = ref.shape[1:3]
    fy, fx = np.arange(h)[:, None] / h, np.arange(w)[None, :] / w
    best, out = np.full(len(ref), np.inf), comp.copy()
    for sy in np.linspace(-0.5, 0.5, 7):
        for sx in np.linspace(-0.5, 0.5, 7):
            moved = comp * np.exp(-2j * np.pi * (fx * sx + fy * sy))[..., None]
            cost = (np.abs(ref - moved) ** 2).sum((1, 2, 3))
            nearer = cost < best
            best[nearer], out[nearer] = cost[nearer], moved[nearer]
    return out


def _bin_weight(d2: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """How much of the reference each bin takes; noise has one number for each tile and bin (or tile)."""
    w = d2 / (d2 + np.maximum(1e-9, noise))
    n = w.shape[-1]
    joint = 0.5 * (w.sum(-1) - w.min(-1) - w.max(-1)) if n >= 4 else w.mean(-1)
    return np.clip(joint, 0, 1)[..., None]


def _spectra(tiles: np.ndarray) -> np.ndarray:
    win = np.outer(raised_cosine(tiles.shape[1]), raised_cosine(tiles.shape[2]))[..., None]
    return np.fft.fft2(tiles * win, axes=(1, 2))


def _rms(tiles: np.ndarray) -> np.ndarray:
    return (0.25 * np.sqrt((np.maximum(0, tiles) ** 2).sum((1, 2))) / TILE).mean(-1)


def merge_tiles(r: np.ndarray, comps: list[np.ndarray], wn: list[float], nr: float) -> np.ndarray:
    """Merged tiles (tiles, h, w, c) of the standard merge."""
    _, read, norm = noise_terms(nr)
    noise = ((_rms(r) + read) * TILE * TILE * norm)[:, None, None, None]
    ref = _spectra(r)
    total = ref.copy()
    for c, k in zip(comps, wn, strict=True):
        moved = best_phase(ref, _spectra(c))
        w = _bin_weight(np.abs(ref - moved) ** 2, noise)
        total += k * ((1 - w) * moved + w * ref)
    return np.fft.ifft2(total, axes=(1, 2)).real / (1 + sum(wn))


def merge_tiles_robust(r: np.ndarray, comps: list[np.ndarray], scale: list[float], difference: np.ndarray, nr: float, white: float, black: float) -> np.ndarray:
    """Merged tiles of the robust merge; difference (comparisons, tiles) is the windowed mean difference around each tile."""
    rev, read, norm = noise_terms(nr)
    rms, ref = _rms(r), _spectra(r)
    total = ref.copy()
    most = max(1.0, 1.3 ** (11 - rev))
    ef = [1 / max(1e-6, s) for s in scale]
    mismatch = np.array([d / np.maximum(1e-9, np.sqrt(0.5 * rms + 0.5 * rms / max(1, e) + 1)) for d, e in zip(difference, ef, strict=True)])
    mismatch = np.clip(mismatch * (0.12 / np.maximum(1e-12, mismatch.mean(0))), 0, 1)
    for c, e, mm in zip(comps, ef, mismatch, strict=True):
        moved = best_phase(ref, _spectra(c))
        motion = np.clip(most - (mm - 0.02) * (most - 1) / 0.15, 1, most)
        clipped = np.clip(((np.maximum(c.max(-1), 0) * e + black) / max(1.0, white) - 0.5) / 0.49, 0, 1).mean((1, 2))
        bright = np.clip((1 - clipped) ** 2, 0.04 / min(max(1, e), 4), 1)
        size = np.ones(ref.shape[:3])
        if abs(e - 1) < 1e-3:
            ratio = np.abs(moved).sum(-1) / np.maximum(1e-12, np.abs(ref).sum(-1))
            like = np.clip(1 - 10 * (mm - 0.2), 0, 1)[:, None, None] * np.clip(ratio**4, 0.5, 3)
            size = np.where((mm < 0.3)[:, None, None], like, size)
            size[:, 0, 0] = 1
        noise = size * (min(4, e) * np.sqrt(motion) * (rms + read) * TILE * TILE * norm * bright)[:, None, None]
        w = _bin_weight(np.abs(ref - moved) ** 2, noise[..., None])
        total += (1 - w) * moved + w * ref
    mean = mismatch.mean(0)
    mag = np.abs(total).sum(-1)
    delta = np.clip(1 - 10 * (mean - 0.2), 0, 1)[:, None, None] * np.clip(1.25 - 25 * mag / np.maximum(1e-12, mag[:, :1, :1]), 0, 1)
    h, w = ref.shape[1:3]
    gain = (1 + delta * SHARPEN[None, None, :w]) * (1 + delta * SHARPEN[None, :h, None])
    gain[:, 0, 0] = 1
    gain[mean >= 0.3] = 1
    return np.fft.ifft2(total * gain[..., None], axes=(1, 2)).real / (1 + len(comps))


def _differences(r: np.ndarray, comps: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """(comparisons, tiles): windowed mean difference over the doubled tile at each (y, x) of `at`, without cells outside the image."""
    win = 0.5 - 0.17 * np.cos(2 * np.pi * (np.arange(2 * TILE) + 0.5) / TILE)  # two periods
    win = np.outer(win, win)
    pad = ((STRIDE, TILE + STRIDE), (STRIDE, TILE + STRIDE))
    around = lambda a: np.lib.stride_tricks.sliding_window_view(np.pad(a, pad), (2 * TILE, 2 * TILE))[at[:, 0], at[:, 1]]
    weight = (around(np.ones(r.shape[:2])) * win).sum((1, 2))
    return np.array([(around(np.abs(r - c).mean(-1)) * win).sum((1, 2)) / weight for c in comps])


def tile_sums(r: np.ndarray, comps: list[np.ndarray], scale: list[float], wn: list[float], at: np.ndarray, origin: tuple[int, int], size: tuple[int, int], nr: float, robust: bool, white: float, black: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each pass the sums of the merged tiles and of their windows over a region of an image of the given size.

    origin is the region's place in the image, `at` the tiles' places in the
    region, which holds all that they read.
    """
    out = {p: (np.zeros_like(r), np.zeros(r.shape[:2])) for p in range(len(PASSES) if robust else 1)}
    shape = np.minimum(TILE, np.array(size) - origin - at)  # tiles at the far edges are smaller
    for h, w in sorted(set(map(tuple, shape.tolist()))):
        some = at[(shape == (h, w)).all(1)]
        cut = lambda a: np.lib.stride_tricks.sliding_window_view(a, (h, w), (0, 1))[some[:, 0], some[:, 1]].transpose(0, 2, 3, 1)  # noqa: B023, E731
        parts = [cut(c) for c in comps]
        merged = merge_tiles_robust(cut(r), parts, scale, _differences(r, comps, some), nr, white, black) if robust else merge_tiles(cut(r), parts, wn, nr)
        win = np.outer(raised_cosine(h), raised_cosine(w))
        for (y, x), tile in zip(some.tolist(), merged, strict=True):
            for p, (total, weight) in out.items():
                if y + origin[0] >= PASSES[p][0] and x + origin[1] >= PASSES[p][1]:
                    total[y : y + h, x : x + w] += tile
                    weight[y : y + h, x : x + w] += win
    return out


def finished(sums: dict[int, tuple[np.ndarray, np.ndarray]], robust: bool) -> np.ndarray:
    """Each pass normalised by its windows (robust: at least -1), then the mean of the passes that cover a cell."""
    done = [(s / np.maximum(1e-6, w)[..., None], w > 1e-6) for s, w in sums.values()]
    total = sum(np.maximum(v, -1.0) if robust else v for v, _ in done)
    return total / np.maximum(1, sum(k.astype(int) for _, k in done))[..., None]


def merge_arrays(frames: list[np.ndarray], ref: int, scale: list[float], wn: list[float], nr: float, robust: bool, white: float = -1, black: float = 0) -> np.ndarray:
    """Merge aligned (h, w, c) frames; frames[ref] is the reference."""
    _check_levels(robust, white, black)
    others = [i for i in range(len(frames)) if i != ref]
    r = frames[ref]
    if not others:
        return r
    h, w, _ = r.shape
    at = np.stack(np.meshgrid(np.arange(0, h, STRIDE), np.arange(0, w, STRIDE), indexing="ij"), -1).reshape(-1, 2)
    return finished(tile_sums(r, [frames[i] for i in others], [scale[i] for i in others], [wn[i] for i in others], at, (0, 0), (h, w), nr, robust, white, black), robust)


def _check_levels(robust: bool, white: float, black: float) -> None:
    if robust and (white < 0 or black < 0):
        raise ValueError("the robust merge needs white and black levels")


def merge(px: DataFrame, nr: float, robust: bool = False, bracketed: bool = False, white: float = -1, black: float = 0) -> DataFrame:
    """Merge px (with ref, scale and wn of each frame).  A burst without comparisons keeps its reference."""
    _check_levels(robust, white, black)
    before, behind = (STRIDE, TILE + STRIDE) if robust else (0, TILE)  # cells that a tile reads before and from its start

    def blocks(axis: str):  # those with a tile that reads the cell
        first = F.greatest(F.lit(0), F.floor((F.col(axis) - (behind - 1)) / BLOCK))
        return F.explode(F.sequence(first.cast("int"), F.floor((F.col(axis) + before) / BLOCK).cast("int")))

    size = px.groupBy("burst").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    cells = px.select("burst", "frame", "y", "x", "c", "v", "ref", "scale", "wn").withColumn("by", blocks("y")).withColumn("bx", blocks("x")).join(size, "burst")
    cells = cells.where((F.col("by") * BLOCK < F.col("h")) & (F.col("bx") * BLOCK < F.col("w")))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(pdf.by.iloc[0]) * BLOCK, int(pdf.bx.iloc[0]) * BLOCK
        size = int(pdf.h.iloc[0]), int(pdf.w.iloc[0])
        origin = np.array([pdf.y.min(), pdf.x.min()])
        shape = (pdf.y.max() + 1 - origin[0], pdf.x.max() + 1 - origin[1], pdf.c.max() + 1)
        frames, meta = {}, {}
        for f, g in pdf.groupby("frame"):
            frames[f] = np.zeros(shape)
            frames[f][g.y - origin[0], g.x - origin[1], g.c] = g.v
            meta[f] = float(g.scale.iloc[0]), float(g.wn.iloc[0]) if bracketed else 1.0
        ref = pdf.ref.iloc[0]
        others = sorted(f for f in frames if f != ref)
        ys, xs = np.arange(y0, min(size[0], y0 + BLOCK), STRIDE), np.arange(x0, min(size[1], x0 + BLOCK), STRIDE)
        at = np.stack(np.meshgrid(ys, xs, indexing="ij"), -1).reshape(-1, 2) - origin
        if others:
            sums = tile_sums(frames[ref], [frames[f] for f in others], [meta[f][0] for f in others], [meta[f][1] for f in others], at, tuple(origin), size, nr, robust, white, black)
        else:
            own = np.zeros(shape[:2])
            own[max(0, y0 - origin[0]) : y0 + BLOCK - origin[0], max(0, x0 - origin[1]) : x0 + BLOCK - origin[1]] = 1
            sums = {0: (frames[ref] * own[..., None], own)}
        out = []
        for p, (total, weight) in sums.items():
            y, x, c = (a.ravel() for a in np.indices(shape))
            w = np.repeat(weight.ravel(), shape[2])
            out.append(pd.DataFrame({"burst": pdf.burst.iloc[0], "y": y + origin[0], "x": x + origin[1], "c": c, "pass": p, "s": total.ravel(), "w": w})[w > 0])
        return pd.concat(out)

    parts = cells.groupBy("burst", "by", "bx").applyInPandas(one, "burst int, y int, x int, c int, `pass` int, s double, w double")
    by_pass = parts.groupBy("burst", "y", "x", "c", "pass").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
    v = F.col("s") / F.greatest(F.lit(1e-6), F.col("w"))
    v = F.greatest(v, F.lit(-1.0)) if robust else v
    return by_pass.groupBy("burst", "y", "x", "c").agg((F.sum(v) / F.greatest(F.lit(1), F.sum((F.col("w") > 1e-6).cast("int")))).alias("v"))
