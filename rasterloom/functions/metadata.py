"""Columns derived from a raw file's tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sensitivity(iso: Column, rating: Column, standard: Column) -> Column:
    """ISO speed, else the first rating, else the standard output sensitivity; 0 if none is known."""
    known = lambda c: F.when(c > 0, c)
    return F.coalesce(known(iso), known(rating), known(standard), F.lit(0))


def exposure_value(time: Column, iso: Column, f_number: Column) -> Column:
    """Exposure time times sensitivity over the squared aperture, without it if that is unknown; 0 if time or sensitivity are."""
    light = time * iso
    return F.when((time > 0) & (iso > 0), F.when(f_number > 0, light / (f_number * f_number)).otherwise(light)).otherwise(F.lit(0.0))


def black_levels(values: Column, rows: Column, columns: Column) -> Column:
    """Black level of each cell of a 2x2 mosaic from a repeated pattern (values in row order): one value is for all cells, cells that the pattern lacks have 0."""
    cell = lambda r, c: F.when((rows > r) & (columns > c), F.get(values, F.lit(r) * columns + c)).otherwise(F.lit(0.0))
    single = (rows == 1) & (columns == 1)
    return F.when(single, F.array_repeat(F.get(values, F.lit(0)), 4)).otherwise(F.array(cell(0, 0), cell(0, 1), cell(1, 0), cell(1, 1)))


def colour_factors(balance: Column) -> Column:
    """Reciprocals of the analog balance of up to four channels; 1 where it is 0 or missing."""
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(F.coalesce(F.get(balance, i), F.lit(0.0)) != 0, 1 / F.get(balance, i)).otherwise(F.lit(1.0)))


def depth_of_white(white: Column) -> Column:
    """Bits of a sample by the white level."""
    return F.when(white <= 255, 8).when(white <= 4095, 12).when(white <= 16383, 14).otherwise(16)
