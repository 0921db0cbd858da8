"""Lens-correction fits from knots."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_knots(text: Column) -> Column:
    """Whole numbers of a text; a leading count (17 or more values, the first at most 32) goes."""
    v = F.transform(F.filter(F.split(F.trim(text), r"[\s,]+"), lambda x: x != ""), lambda x: x.cast("int"))
    v = F.when((F.size(v) >= 17) & (v[0] <= 32), F.slice(v, 2, 1000)).otherwise(v)
    return F.slice(v, 1, 16)


def distortion_points(knots: Column) -> Column:
    """(x, y): squared radius and relative magnification of each knot."""
    return F.transform(knots, lambda k, i: F.struct(F.pow(i / 15.0, F.lit(2.0)).alias("x"), ((1 + k / 16384.0) / (1 + knots[15] / 16384.0)).alias("y")))


def vignette_points(knots: Column) -> Column:
    return F.transform(F.slice(knots, 1, 15), lambda k, i: F.struct(F.pow(i / 14.0, F.lit(2.0)).alias("x"), ((k - knots[0]) / 16384.0).alias("y")))


def moments(points: DataFrame, key: str, degree: int) -> DataFrame:
    """Sums of x**k and x**k * y by key: the normal equations of a polynomial fit; points(key, x, y)."""
    return points.groupBy(key).agg(*(F.sum(F.pow("x", F.lit(float(k)))).alias(f"s{k}") for k in range(2 * degree + 1)), *(F.sum(F.pow("x", F.lit(float(k))) * F.col("y")).alias(f"t{k}") for k in range(degree + 1)))


def solve(m: DataFrame, key: str, degree: int, constant: bool = True) -> DataFrame:
    """Coefficients of each key's fit, as an array; without the constant the powers begin at 1."""
    first = 0 if constant else 1

    def one(batches):
        for b in batches:
            if not len(b):
                continue
            s, t = (np.stack([b[f"{m}{i}"].to_numpy() for i in range(n)], 1) for m, n in (("s", 2 * degree + 1), ("t", degree + 1)))
            i = np.arange(first, degree + 1)
            a = s[:, i[:, None] + i]
            got = b[[key]].copy()
            got["k"] = list((np.linalg.pinv(a) @ t[:, first:, None])[..., 0])
            yield got

    return m.mapInPandas(one, f"{key} {dict(m.dtypes)[key]}, k array<double>")


def warp_factor(r: Column, k: list[float]) -> Column:
    return sum(F.lit(c) * F.pow(r, F.lit(2.0 * i)) for i, c in enumerate(k))


def vignette_gain(r: Column, k: list[float]) -> Column:
    return 1 + sum(F.lit(c) * F.pow(r, F.lit(2.0 * i + 2)) for i, c in enumerate(k))


def opcode_list(distortion: list[float], vignette: list[float] | None = None, cx: float = 0.5, cy: float = 0.5) -> bytes:
    """Big-endian opcode list: WarpRectilinear (1) and, if there is a vignette, FixVignetteRadial (3)."""
    parts = [(1, struct.pack(">I6d2d", 1, *distortion[:4], 0.0, 0.0, cx, cy))]
    if vignette is not None:
        parts.append((3, struct.pack(">5d2d", *vignette[:5], cx, cy)))
    return struct.pack(">I", len(parts)) + b"".join(struct.pack(">IIII", code, 0x01030000, 1, len(body)) + body for code, body in parts)
