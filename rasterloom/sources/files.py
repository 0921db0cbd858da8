"""Input files: listing, classification and decoding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import few
from . import codecs

# The file extensions of camera raw and of plain images.
RAW = (
    "dng", "arw", "cr2", "cr3", "nef", "nrw", "orf", "raf", "rw2", "pef", "srw", "x3f", "sr2",
    "srf", "kdc", "dcr", "k25", "mdc", "mef", "mrw", "iiq", "eip", "bay", "3fr", "fff", "mos",
)
RGB = ("jpg", "jpeg", "png", "bmp", "tif", "tiff")


def listed(spark: SparkSession, files: list[str] = (), folders: list[str] = ()) -> DataFrame:
    """path and frame of a burst's inputs: the files as given, then each folder's in path order (no subfolders).  A missing folder, or one that is a file, is an error; no input at all, too."""
    paths = list(files)
    for folder in folders:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if not system.exists(at) or not system.getFileStatus(at).isDirectory():
            raise ValueError(f"no such folder: {folder}")
        paths += sorted(x.getPath().toString() for x in system.listStatus(at) if x.isFile())  # names only
    if not paths:
        raise ValueError("no input files")
    return spark.createDataFrame(list(enumerate(paths)), "frame int, path string")


def scan(spark: SparkSession, folder: str | None = None, files: list[str] = ()) -> DataFrame:
    """path, frame, length and content of the inputs; only names are numbered in one place, contents stay where they are read."""
    names = listed(spark, files, [folder] if folder else [])
    paths = [r.path for r in names.collect()]
    got = spark.read.format("binaryFile").load(paths)
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    names_ = few(names.select(plain(F.col("path")).alias("__name"), "frame"))
    return got.withColumn("__name", plain(F.col("path"))).join(names_, "__name").drop("__name")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))


def classify(inputs: DataFrame) -> DataFrame:
    """Kind of each burst's files (raw, rgb, mixed; unknown if any is neither) and the number of raw ones."""
    k = inputs.select("burst", extension(F.col("path")).isin(*RAW).alias("raw"), extension(F.col("path")).isin(*RGB).alias("rgb"))
    kind = F.when(F.bool_or(~F.col("raw") & ~F.col("rgb")), "unknown").when(F.bool_or("raw") & F.bool_or("rgb"), "mixed").when(F.bool_or("raw"), "raw").otherwise("rgb")
    return k.groupBy("burst").agg(kind.alias("kind"), F.sum(F.col("raw").cast("long")).alias("n_raw"))


def known(inputs: DataFrame) -> DataFrame:
    """The inputs; reading one whose extension is neither raw nor plain is an error."""
    good = extension(F.col("path")).isin(*RAW, *RGB)
    return inputs.where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unsupported input file format: "), "path")).cast("boolean")))


def keep_raw(inputs: DataFrame) -> DataFrame:
    """Mixed input: only the raw files."""
    return inputs.where(extension(F.col("path")).isin(*RAW))


def decode(path: str, data: bytes) -> tuple[np.ndarray, float]:
    """Samples (h, w, channels) and white level by the extension."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    if ext not in codecs.DECODERS:
        raise ValueError(f"unsupported file format: {path}")
    return codecs.DECODERS[ext](data)


PIXELS = "burst int, frame int, y int, x int, c int, v double, white double"
_ROWS = 1 << 18


def pixels(files: DataFrame) -> DataFrame:
    """Pixels and white level of bitmap, PNG and TIFF files (burst, frame, path, content); other extensions are an error.  A task holds one image."""
    schema = pa.schema([("burst", pa.int32()), ("frame", pa.int32()), ("y", pa.int32()), ("x", pa.int32()), ("c", pa.int32()), ("v", pa.float64()), ("white", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                burst, frame, path, content = (b.column(k)[i].as_py() for k in range(4))
                image, white = decode(path, content)
                h, w, n = image.shape
                step = max(1, _ROWS // (w * n))
                for y in range(0, h, step):
                    part = image[y : y + step]
                    at = [a.ravel() for a in np.indices(part.shape)]
                    same = lambda v: np.full(part.size, v)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip((same(burst), same(frame), at[0] + y, at[1], at[2], part.ravel().astype(float), same(white)), schema, strict=True)], schema=schema)

    return files.select("burst", "frame", "path", "content").mapInArrow(run, PIXELS)


def jpeg_pixels(spark: SparkSession, names: DataFrame) -> DataFrame:
    """Pixels of JPEG files (frame, path, burst) by Spark's image source: grey or RGB of 8 bits; anything else (CMYK) is an error."""
    paths = [r.path for r in names.select("path").collect()]  # a burst's files
    got = spark.read.format("image").load(paths).select("image.*")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    named = few(names.select(plain(F.col("path")).alias("name"), "burst", "frame"))
    got = got.withColumn("name", plain(F.col("origin"))).join(named, "name")
    schema = pa.schema([("burst", pa.int32()), ("frame", pa.int32()), ("y", pa.int32()), ("x", pa.int32()), ("c", pa.int32()), ("v", pa.float64()), ("white", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                name, burst, frame, h, w, n, data = (b.column(k)[i].as_py() for k in range(7))
                if n not in (1, 3) or h <= 0:
                    raise ValueError(f"not a grey or RGB JPEG: {name}")
                image = np.frombuffer(data, np.uint8).reshape(h, w, n)[:, :, ::-1]  # stored blue first
                step = max(1, _ROWS // (w * n))
                for y in range(0, h, step):
                    part = image[y : y + step]
                    at = [a.ravel() for a in np.indices(part.shape)]
                    same = lambda v: np.full(part.size, v)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip((same(burst), same(frame), at[0] + y, at[1], at[2], part.ravel().astype(float), same(255.0)), schema, strict=True)], schema=schema)

    return got.select("name", "burst", "frame", "height", "width", "nChannels", "data").mapInArrow(run, PIXELS)


def images(spark: SparkSession, names: DataFrame, burst: int = 0) -> DataFrame:
    """Pixels and white level of a burst's plain image files (frame, path), each by the decoder of its extension."""
    names = names.withColumn("burst", F.lit(burst))
    kinds = {r.path.rsplit(".", 1)[-1].lower() for r in names.select("path").collect()}
    if bad := kinds - set(RGB):
        raise ValueError(f"unsupported file format: {', '.join(sorted(bad))}")
    is_jpeg = extension(F.col("path")).isin("jpg", "jpeg")
    out = spark.createDataFrame([], PIXELS)
    if kinds & {"jpg", "jpeg"}:
        out = out.unionByName(jpeg_pixels(spark, names.where(is_jpeg)))
    if kinds - {"jpg", "jpeg"}:
        rest = [r.path for r in names.where(~is_jpeg).orderBy("frame").collect()]
        got = scan(spark, files=rest).drop("frame")
        plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
        named = few(names.select(plain(F.col("path")).alias("name"), "burst", "frame"))
        out = out.unionByName(pixels(got.withColumn("name", plain(F.col("path"))).join(named, "name")))
    return out


def raw_samples(data: DataFrame, kind: str, width: int, channels: int = 1, scale: float = 1.0) -> DataFrame:
    """Pixels of raw sample buffers (burst, frame, content): little-endian u8, u16 or f32, rows of width cells, times scale."""
    of = np.dtype({"u8": "u1", "u16": "<u2", "f32": "<f4"}[kind])
    schema = pa.schema([("burst", pa.int32()), ("frame", pa.int32()), ("y", pa.int32()), ("x", pa.int32()), ("c", pa.int32()), ("v", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                burst, frame, content = (b.column(k)[i].as_py() for k in range(3))
                v = np.frombuffer(content, of).astype(float) * scale
                for s in range(0, len(v), _ROWS):
                    part = v[s : s + _ROWS]
                    at = np.arange(s, s + len(part))
                    cell = at // channels
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((np.full(len(part), burst), np.full(len(part), frame), cell // width, cell % width, at % channels, part), schema, strict=True)], schema=schema)

    return data.select("burst", "frame", "content").mapInArrow(run, "burst int, frame int, y int, x int, c int, v double")
