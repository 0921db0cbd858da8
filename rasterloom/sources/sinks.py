"""Output files: path and format rules, and writing a quantised frame."""

from __future__ import annotations

from pathlib import PurePosixPath

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tone
from . import codecs

EXTENSIONS = {"png": ("png",), "jpeg": ("jpg", "jpeg"), "bmp": ("bmp",), "tiff": ("tif", "tiff"), "dng": ("dng",)}
NAME = "burst_output"


def format_of(path: str, asked: str = "auto", all_raw: bool = False) -> str:
    """The format asked for, else that of the path's extension, else dng for raw inputs and png for others."""
    if asked != "auto":
        if asked not in EXTENSIONS:
            raise ValueError(f"unknown output format: {asked}")
        return asked
    ext = PurePosixPath(path).suffix[1:].lower()
    return next((f for f, known in EXTENSIONS.items() if ext in known), "dng" if all_raw else "png")


def resolve_path(path: str, fmt: str, name: str = NAME) -> str:
    """The output file: a path with an extension is one, its extension set right if it is another format's; without, it is the folder of a file of a fixed name."""
    out = PurePosixPath(path or ".")
    known = EXTENSIONS[fmt]
    if not out.suffix:
        return str(out / f"{name}.{known[0]}")
    return str(out) if out.suffix[1:].lower() in known else str(out.with_suffix("." + known[0]))


def check_channels(fmt: str, channels: int) -> None:
    if channels not in codecs.CHANNELS.get(fmt, ()):
        raise ValueError(f"no {fmt} of {channels} channels")


def white_of(whites: list[float]) -> float:
    """White level of the first input that has one over 1; 255 if none has."""
    return next((w for w in whites if w > 1), 255.0)


def quantised(px: DataFrame, fmt: str, depth: int, white: float) -> DataFrame:
    """px (burst, y, x, c, v) as whole numbers of the depth that the format takes."""
    top = 2.0 ** tone.snap_depth(depth, fmt) - 1
    return px.withColumn("v", tone.quantize(F.col("v"), white, top))


def encoded(px: DataFrame, fmt: str, depth: int) -> DataFrame:
    """burst and content: the file of each burst's quantised frame.  An image file is one piece, so a burst is one task."""
    kind = np.uint16 if tone.snap_depth(depth, fmt) == 16 else np.uint8
    encode, limits = codecs.ENCODERS[fmt], codecs.CHANNELS[fmt]

    def one(pdf):
        import pandas as pd

        shape = int(pdf.y.max()) + 1, int(pdf.x.max()) + 1, int(pdf.c.max()) + 1
        if shape[2] not in limits:
            raise ValueError(f"no {fmt} of {shape[2]} channels")
        image = np.zeros(shape, kind)
        image[pdf.y, pdf.x, pdf.c] = pdf.v
        return pd.DataFrame({"burst": [pdf.burst.iloc[0]], "content": [encode(image)]})

    return px.select("burst", "y", "x", "c", "v").groupBy("burst").applyInPandas(one, "burst int, content binary")


def write(spark: SparkSession, px: DataFrame, path: str, depth: int = 16, fmt: str = "auto", whites: list[float] = (255.0,), all_raw: bool = False) -> str:
    """Write one burst's merged frame; returns the file's path.  Raw containers are not written: such a result is kept as pixels and frames."""
    fmt = format_of(path, fmt, all_raw)
    if fmt == "dng":
        raise ValueError("no raw container is written" if all_raw else "no raw output for inputs that are not raw")
    out = resolve_path(path, fmt)
    content = encoded(quantised(px, fmt, depth, white_of(list(whites))), fmt, depth).first()["content"]
    at = spark._jvm.org.apache.hadoop.fs.Path(out)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        stream.write(content, 0, len(content))
    finally:
        stream.close()
    return out


def dump_field(field: DataFrame, path: str) -> None:
    """A motion field as text: one line of dx and dy for each tile, rows first, in a folder for each burst and frame."""
    line = field.select("burst", "frame", "ty", "tx", F.concat_ws(" ", "dx", "dy").alias("value"))
    line.repartition("burst", "frame").sortWithinPartitions("burst", "frame", "ty", "tx").select("burst", "frame", "value").write.mode("overwrite").partitionBy("burst", "frame").text(path)


def dump_region(region: DataFrame, path: str) -> None:
    """Cells (x, y, raw_value) as CSV with a header."""
    region.select("x", "y", "raw_value").sort("y", "x").write.mode("overwrite").option("header", True).csv(path)


def dump_gray(spark: SparkSession, gray: DataFrame, path: str, white: float) -> str:
    """One gray frame as a bitmap."""
    return write(spark, gray.select("burst", "y", "x", F.lit(0).alias("c"), "v"), path, 8, "bmp", [white])
