"""Exact top-k inner products over norm-sorted, rotated vectors.

Components become floor(64 * x), stored as narrow as they fit.  Candidates are
dealt to shards by ranges of their length (a length that many share is salted),
sorted by descending length within each and packed into blocks.  Each query gets
a lower bound of its k-th score from the HEAD longest vectors of all, so a block
of queries meets only the shards whose longest vector can still reach one of
these bounds.  There candidates come in order of length; a query leaves a shard
once its length times the block's longest length cannot reach its k-th score.
Before that, the inner product over the first PREFIX axes of an orthogonal
rotation (right singular vectors of all vectors) plus the product of the residual
lengths bounds each score from above (Cauchy-Schwarz); only candidates whose
bound reaches the k-th score are scored exactly, in integers.

The work is queries times candidates by nature.  Blocks of QUERY_BLOCK queries and
shards of SHARD_ROWS rows keep what is shuffled at about a 16,000th of that.

Vectors that are null, or hold a null or non-finite component, take no part, nor
do rows without a vec_id.  Shorter vectors count as padded with zeros.  A query
skips all rows of its own vec_id; repeated rows are candidates each, and each
repeated query row has its own ranks.  Ties go to the smaller vec_id.  An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, record_batch, shuffle_partitions, table

K, EVERY, PREFIX, HEAD = 20, 20, 16, 4096
QUERY_BLOCK, BLOCK, SHARD_ROWS, LEAST_ROWS = 16_384, 4096, 65_536, 2048


def _vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their components as int64 padded to dim)."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)  # nulls become NaN
    rows = np.repeat(np.arange(len(column)), lengths)
    out = np.zeros((len(column), dim))
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    good = column.is_valid().to_numpy(zero_copy_only=False)
    good[rows[~np.isfinite(values)]] = False
    at = np.flatnonzero(good)
    return at, np.floor(64 * out[at]).astype(np.int64)


def _stored(x: np.ndarray) -> list[bytes]:
    """Rows of integers as bytes, in the narrowest of 2, 4 and 8 bytes each that holds them all."""
    most = int(max(x.max(initial=0), -x.min(initial=0)))
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return [r.tobytes() for r in x.astype(kind)]


def _restored(data: list[bytes], dim: int) -> np.ndarray:
    """Rows of integers that _stored() made, in any widths."""
    width = np.array([len(d) // dim for d in data], np.int64)
    out = np.empty((len(data), dim), np.int64)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        out[at] = np.frombuffer(b"".join(data[i] for i in at.tolist()), f"<i{w}").reshape(-1, dim)
    return out


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Orthogonal axes by descending spread, from the summed outer products of all vectors."""
    schema = pa.schema([("i", pa.int32()), ("v", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            x = _restored(b.column(0).to_pylist(), dim).astype(float)
            total += x.T @ x
        yield record_batch({"i": np.arange(dim * dim), "v": total.ravel()}, schema)

    got = vectors.select("data").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v")).collect()
    gram = np.zeros(dim * dim)
    for i, v in got:
        gram[i] = v
    gram = gram.reshape(dim, dim)
    return np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1] if np.isfinite(gram).all() else np.eye(dim)


class BlockSearch:
    """Top k of a block of queries over candidate blocks that come by descending length."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, axes: np.ndarray, k: int, least: np.ndarray | None = None):
        self.ids, self.q, self.axes, self.k = ids, q, axes, k
        self.rotated = q @ axes
        self.norm = np.sqrt((self.rotated**2).sum(1))
        self.rest = np.sqrt((self.rotated[:, PREFIX:] ** 2).sum(1))
        self.score = [np.zeros(0, np.int64)] * len(ids)
        self.vec = [np.zeros(0, np.int64)] * len(ids)
        self.least = np.full(len(ids), -np.inf) if least is None else least.copy()  # no k-th score is lower
        self.pruned = self.scored = 0

    def feed(self, ids: np.ndarray, c: np.ndarray) -> None:
        rotated = c @ self.axes
        longest = np.sqrt((rotated**2).sum(1).max())
        slack = 1e-9 * (1 + self.norm * longest)
        live = np.flatnonzero(self.norm * longest + slack >= self.least)
        if not len(live):
            self.pruned += len(self.ids) * len(ids)
            return
        rest = np.sqrt((rotated[:, PREFIX:] ** 2).sum(1))
        bound = self.rotated[live, :PREFIX] @ rotated[:, :PREFIX].T + self.rest[live, None] * rest + slack[live, None]
        reach = bound >= self.least[live, None]
        for n, qi in enumerate(live.tolist()):
            at = np.flatnonzero(reach[n])
            at = at[ids[at] != self.ids[qi]]
            self.scored += len(at)
            scores = c[at] @ self.q[qi]
            good = scores >= self.least[qi]
            if good.any():
                self._offer(qi, ids[at[good]], scores[good])

    def _offer(self, qi: int, ids: np.ndarray, scores: np.ndarray) -> None:
        k = self.k
        if len(scores) > 4 * k:
            cut = np.partition(scores, len(scores) - k)[len(scores) - k]
            best = scores >= cut
            ids, scores = ids[best], scores[best]
        s, v = np.concatenate((self.score[qi], scores)), np.concatenate((self.vec[qi], ids))
        order = np.lexsort((v, -s))[:k]
        self.score[qi], self.vec[qi] = s[order], v[order]
        if len(order) == k:
            self.least[qi] = max(self.least[qi], float(s[order[-1]]))


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null")
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0
    if dim <= 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    scratch = Scratch(spark)
    flat = pa.schema([("id", pa.int64()), ("norm", pa.float64()), ("data", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = _vectors(b.column(1), dim)
            if len(at):
                yield record_batch({"id": b.column(0).take(pa.array(at)), "norm": np.sqrt((x.astype(float) ** 2).sum(1)), "data": _stored(x)}, flat)

    ready = scratch.write(rows.mapInArrow(read, "id long, norm double, data binary"), "vectors")
    parts = shuffle_partitions(spark)
    total, queries, longest = ready.agg(F.count(F.lit(1)), F.sum((F.col("id") % every == 0).cast("long")), F.max("norm")).first()
    if not queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n_blocks = -(-queries // QUERY_BLOCK)
    n_ranges = max(-(-total // SHARD_ROWS), min(4 * parts, -(-total // LEAST_ROWS)))
    marks = ready.agg(F.percentile_approx("norm", [i / n_ranges for i in range(1, n_ranges)], 10 * n_ranges)).first()[0] if n_ranges > 1 else []
    # ranges (split before, split]; one whose split is several marks has a shard for each of these
    splits, times = np.unique(np.array(marks, float), return_counts=True)
    tops = np.append(splits, longest)
    salts = np.append(times, 1)
    first = np.cumsum(salts) - salts
    tops_of = np.repeat(tops, salts)  # longest length that a shard can hold
    axes = rotation(ready, dim)
    # at most HEAD rows
    head = ready.orderBy(F.desc("norm"), "id").limit(HEAD).select("id", "data").toArrow()
    shared = spark.sparkContext.broadcast((axes, tops, tops_of, salts, first, head.column("id").to_numpy(), _restored(head.column("data").to_pylist(), dim)))

    def bounds(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        """A lower bound of the k-th score of each query: that among the longest vectors."""
        _, _, _, _, _, at, longest_ones = shared.value
        out = np.full(len(ids), -np.inf)
        if len(at) > k:
            for i in range(0, len(ids), 256):
                scores = x[i : i + 256] @ longest_ones.T
                mine = ids[i : i + 256, None] == at
                scores[mine] = np.iinfo(np.int64).min
                kth = np.partition(scores, len(at) - k, axis=1)[:, len(at) - k]
                out[i : i + 256] = np.where(len(at) - mine.sum(1) >= k, kth, -np.inf)
        return out

    block_kind = "block long, seq long, ids binary, data binary, least binary, shards array<int>"
    ask = pa.schema([("block", pa.int64()), ("seq", pa.int64()), ("ids", pa.binary()), ("data", pa.binary()), ("least", pa.binary()), ("shards", pa.list_(pa.int32()))])
    has = pa.schema([("shard", pa.int32()), ("seq", pa.int64()), ("ids", pa.binary()), ("data", pa.binary())])

    def packed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(group, number in it, ids, vectors) of runs of at most size rows (group, id, data) of a group."""
        now, seq, ids, data = None, 0, [], []
        for b in batches:
            for group, i, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if group != now or len(ids) >= size:
                    if ids:
                        yield now, seq, np.array(ids, np.int64), _restored(data, dim)
                    now, seq, ids, data = group, (seq + 1 if group == now else 0), [], []
                ids.append(i)
                data.append(d)
        if ids:
            yield now, seq, np.array(ids, np.int64), _restored(data, dim)

    def ask_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops_of = shared.value[2]
        for block, seq, ids, x in packed(batches, QUERY_BLOCK):
            least, norm = bounds(ids, x), np.sqrt((x.astype(float) ** 2).sum(1))
            # a shard whose longest vector can reach some query's bound
            near = np.array([(norm * t * (1 + 1e-9) + 1e-9 >= least).any() for t in tops_of])
            yield record_batch({"block": [block], "seq": [seq], "ids": [ids.tobytes()], "data": [b"".join(_stored(x))], "least": [least.tobytes()], "shards": [np.flatnonzero(near)]}, ask)

    def has_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, seq, ids, x in packed(batches, BLOCK):
            yield record_batch({"shard": [shard], "seq": [seq], "ids": [ids.tobytes()], "data": [b"".join(_stored(x))]}, has)

    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, tops, _, salts, first, _, _ = shared.value
        for b in batches:
            at = np.minimum(np.searchsorted(tops, b.column(1).to_numpy(zero_copy_only=False), side="left"), len(tops) - 1)
            salt = b.column(3).to_numpy(zero_copy_only=False) % salts[at]
            yield pa.RecordBatch.from_arrays([pa.array(first[at] + salt, pa.int32()), b.column(0), b.column(1), b.column(2)], names=["shard", "id", "norm", "data"])

    asks = ready.where(F.col("id") % every == 0).select(F.pmod(F.xxhash64("id", "data"), F.lit(n_blocks)).alias("block"), "id", "data")
    asks = asks.repartition(min(parts, n_blocks), "block").sortWithinPartitions("block", "id").mapInArrow(ask_blocks, block_kind)
    asks = scratch.write(asks, "asks").withColumn("shard", F.explode("shards"))
    need = asks.select("block", "shard").distinct()
    salted = ready.select("id", "norm", "data", F.pmod(F.xxhash64("id", "data"), F.lit(1 << 30)).alias("salt"))
    haves = salted.mapInArrow(sharded, "shard int, id long, norm double, data binary")
    haves = haves.repartition(parts, "shard").sortWithinPartitions("shard", F.desc("norm"), "id").select("shard", "id", "data").mapInArrow(has_blocks, "shard int, seq long, ids binary, data binary")
    # a block of rows is one record, and each pair of a query block and a shard that it needs is a task's unit
    haves = scratch.write(haves, "blocks").join(need, "shard").select("shard", "block", F.lit(1).alias("side"), "seq", "ids", "data", F.lit(None).cast("binary").alias("least"))
    met = asks.select("shard", "block", F.lit(0).alias("side"), "seq", "ids", "data", "least").unionByName(haves)
    met = met.repartition(parts, "shard", "block").sortWithinPartitions("shard", "block", "side", "seq")
    found = pa.schema([("query_id", pa.int64()), ("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, searches = None, []
        axes = shared.value[0]

        def out() -> Iterator[pa.RecordBatch]:
            for number, s in searches:
                n = np.array([len(v) for v in s.vec])
                if n.sum():
                    yield record_batch({"query_id": np.repeat(s.ids, n), "q": np.repeat(number + np.arange(len(n)), n), "vec_id": np.concatenate(s.vec), "score": np.concatenate(s.score)}, found)

        for b in batches:
            for i in range(b.num_rows):
                shard, block, side, seq, ids, data, least = (c[i].as_py() for c in b.columns)
                if (shard, block) != now:
                    yield from out()
                    now, searches = (shard, block), []
                ids = np.frombuffer(ids, np.int64)
                x = np.frombuffer(data, f"<i{len(data) // (len(ids) * dim)}").reshape(-1, dim).astype(np.int64)
                if side == 0:
                    least = np.frombuffer(least)
                    for j in range(0, len(ids), 512):
                        searches.append(((block << 32) + seq * QUERY_BLOCK + j, BlockSearch(ids[j : j + 512], x[j : j + 512], axes, k, least[j : j + 512])))
                else:
                    for _, s in searches:
                        s.feed(ids, x)
        yield from out()

    top = met.mapInArrow(search, "query_id long, q long, vec_id long, score long")
    w = W.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return top.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))
