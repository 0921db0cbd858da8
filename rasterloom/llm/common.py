"""Shared plumbing of the corpus operators: scratch tables, bounded batches, word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_GROUP = 16 << 20
_LOCAL_SCRATCH: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """A new folder under the cluster's spark.checkpoint.dir; without one a local master (tests) gets a local folder, any other is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _LOCAL_SCRATCH.setdefault(app, "file://" + tempfile.mkdtemp(prefix="rasterloom-"))
    return f"{base.rstrip('/')}/rasterloom/{uuid.uuid4().hex}"


class Folder:
    """Parquet tables by name in a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        # small row groups: a writer holds one of them in memory
        df.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def names(self) -> list[str]:
        """Tables that were written to the end, sorted."""
        path, files = self._path()
        found = [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []
        return sorted(n for n in found if files.exists(self._path(f"{n}/_SUCCESS")[0]))

    def drop(self, name: str = "") -> None:
        path, files = self._path(name)
        files.delete(path, True)


_open: list[list[Folder]] = []


class Scratch(Folder):
    """Intermediate tables of one operator call, kept as Parquet in the shared folder so that a lost executor loses nothing.

    They are dropped when the driver ends, or with the enclosing released().
    """

    def __init__(self, spark: SparkSession):
        super().__init__(spark, scratch_root(spark))
        path, files = self._path()
        files.deleteOnExit(path)
        if _open:
            _open[-1].append(self)


@contextmanager
def released() -> Iterator[None]:
    """Drops the Scratch folders that are opened inside, at the end: for callers that have written the result by then."""
    _open.append([])
    try:
        yield
    finally:
        for folder in _open.pop():
            folder.drop()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(column: pa.Array) -> list[str]:
    """Python strings of an Arrow string column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows of about limit bytes each, one row at least."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def byte_sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each string or binary of a column, null as 0."""
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


#: What empties the caches that operators keep in a worker between their tasks, by name.
WORKER_CACHES: dict[str, Callable[[], None]] = {}


def empty_caches(but: str = "") -> None:
    for name, empty in WORKER_CACHES.items():
        if name != but:
            empty()


def text_chunks(column: pa.Array, limit: int, cache: str = "") -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, end, UTF-8 bytes of these rows) by chunks of about limit bytes; only one chunk is copied out of Arrow at a time.  Caches of other operators that the worker served before are emptied."""
    empty_caches(cache)
    for i, j in slices(byte_sizes(column).tolist(), limit):
        yield i, j, utf8(column.slice(i, j - i))


def text_function(make: Callable[[pa.Array], pa.Array], kind: str) -> Callable[[Column], Column]:
    """A scalar Arrow function of a column: only that column goes to Python and only the result comes back.  Marked nondeterministic, so that no plan evaluates it twice."""
    return F.arrow_udf(make, kind).asNondeterministic()


def free_name(columns: list[str], name: str) -> str:
    """name, with underscores added until no column has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column's name as an attribute name, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def record_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of 64-bit keys (in place)."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h
