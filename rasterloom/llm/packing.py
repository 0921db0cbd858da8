"""Best-fit packing of token sequences by linear grouping.

Documents are cut only where longer than the capacity; the plan needs just the
histogram of piece lengths, which the capacity bounds.  Large lengths are sorted
and dealt into groups of equal cardinality, each rounded up to its longest; the
linear programme over configurations of those few sizes is solved by column
generation; its whole configurations are filled with actual lengths, then what
is left and the small lengths go, longest first, where they fit best.  Equal
sequences are kept as one type with a count, so the plan's size follows the
number of distinct lengths, not of documents.

Null texts are empty documents (one end token).  Repeated rows are documents of
their own; very long texts are cut like others.  An empty table gives an empty
result; other columns are not read.  Rows of equal length are interchangeable:
they are numbered within (length, chunk), chunks being a hash of the row, so a
length that most rows share is dealt over all tasks: a chunk holds about a quarter
of a shuffle partition's share of the rows, but no more than CHUNK_ROWS.  The
driver holds a number for each chunk.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import chunked, encoder, vocabulary_path
from .common import Scratch, record_batch, shuffle_partitions, table

#: (n, groups): lengths over capacity / n are large and form so many groups.
CAPACITY, GROUPINGS = 2048, ((2, 24), (3, 48), (2, 0))
END = b"\0\0\0\0"
CHUNK_ROWS = 1 << 18

Kind = tuple[tuple[int, int], ...]  # (length, how many) in a sequence


def solve_configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], float]]:
    """Configurations and their amounts of the linear programme that covers demand with the fewest sequences (revised simplex, knapsack pricing)."""
    m = len(sizes)
    basis = [[capacity // s if i == j else 0 for j in range(m)] for i, s in enumerate(sizes)]
    need, size = np.array(demand, float), np.array(sizes)
    for _ in range(60 * m):
        a = np.array(basis, float).T
        value = np.linalg.solve(a.T, np.ones(m))
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(min(sizes), capacity + 1):  # the best value within c; -1: as within c - 1
            fits = size <= c
            gain = best[c - size[fits]] + value[fits]
            g = int(gain.argmax())
            best[c] = max(best[c - 1], gain[g])
            if gain[g] > best[c - 1] + 1e-12:
                pick[c] = np.flatnonzero(fits)[g]
        if best[capacity] <= 1 + 1e-7:
            break
        new, c = [0] * m, capacity
        while c > 0:
            if pick[c] < 0:
                c -= 1
            else:
                new[pick[c]] += 1
                c -= sizes[pick[c]]
        x, d = np.linalg.solve(a, need), np.linalg.solve(a, np.array(new, float))
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        basis[int(ratio.argmin())] = new
    x = np.linalg.solve(np.array(basis, float).T, need)
    return [(b, float(v)) for b, v in zip(basis, x, strict=True) if v > 1e-9]


class _Runs:
    """Lengths of a group, longest first, as (length, count)."""

    def __init__(self, runs: list[tuple[int, int]]):
        self.runs = [list(r) for r in reversed(runs)]

    def take(self, n: int) -> list[tuple[int, int]]:
        out = []
        while n and self.runs:
            length, have = self.runs[-1]
            k = min(n, have)
            out.append((length, k))
            n -= k
            if k == have:
                self.runs.pop()
            else:
                self.runs[-1][1] -= k
        return out


def _filled(config: list[int], amount: int, groups: list[_Runs]) -> list[tuple[list[int], int]]:
    """(lengths, count) of `amount` sequences of a configuration with actual lengths."""
    slots = [groups[g].take(amount) for g, k in enumerate(config) for _ in range(k)]
    ends = sorted({e for s in slots for e in np.cumsum([k for _, k in s]).tolist()} | {amount})
    out, start = [], 0
    at = [0] * len(slots)
    used = [0] * len(slots)
    for end in ends:
        lengths = []
        for i, s in enumerate(slots):
            if at[i] < len(s):
                lengths.append(s[at[i]][0])
                used[i] += end - start
                if used[i] == s[at[i]][1]:
                    at[i], used[i] = at[i] + 1, 0
        if end > start:
            out.append((lengths, end - start))
        start = end
    return out


def plan(counts: np.ndarray, capacity: int = CAPACITY, groupings: tuple[tuple[int, int], ...] = GROUPINGS) -> list[tuple[list[int], int]]:
    """(lengths in one sequence, number of such sequences) for counts[length] pieces of each length: the plan with the fewest sequences of those for some groupings (0 groups: no configurations, all best-fit)."""
    least = -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)
    best: list[tuple[list[int], int]] = []
    for part, n in groupings:
        made = grouped_plan(counts, capacity, part, n)
        if not best or sum(k for _, k in made) < sum(k for _, k in best):
            best = made
        if sum(k for _, k in best) <= least:
            break
    return best


def grouped_plan(counts: np.ndarray, capacity: int, part: int, groups: int) -> list[tuple[list[int], int]]:
    """plan() for one grouping."""
    out: list[tuple[list[int], int]] = []
    if counts[capacity]:
        out.append(([capacity], int(counts[capacity])))
    rest = [(s, int(counts[s])) for s in range(capacity - 1, 0, -1) if counts[s]]
    large, small = [r for r in rest if r[0] > capacity // part], [r for r in rest if r[0] <= capacity // part]
    total = sum(n for _, n in large)
    waiting: list[tuple[int, int]] = []
    open_: list[tuple[list[int], int]] = []
    if total > groups > 0:
        runs, parts, sizes = _Runs(large), [], []
        for g in range(groups):
            taken = runs.take(total * (g + 1) // groups - total * g // groups)
            if sizes and taken[0][0] == sizes[-1]:
                parts[-1] += taken
            else:
                parts.append(taken)
                sizes.append(taken[0][0])
        demand = [sum(n for _, n in p) for p in parts]
        left = [_Runs(p) for p in parts]
        for config, amount in solve_configurations(sizes, demand, capacity):
            if int(amount + 1e-9):
                open_ += _filled(config, int(amount + 1e-9), left)
        waiting = [tuple(r) for x in left for r in reversed(x.runs)]
    else:
        waiting = large
    merged: dict[int, int] = {}
    for s, n in waiting + small:
        merged[s] = merged.get(s, 0) + n
    gaps: dict[int, list[tuple[list[int], int]]] = {}
    order: list[int] = []  # gaps that have sequences, ascending

    def put(lengths: list[int], n: int) -> None:
        gap = capacity - sum(lengths)
        if gap not in gaps:
            gaps[gap] = []
            insort(order, gap)
        gaps[gap].append((lengths, n))

    for lengths, n in open_:
        put(lengths, n)
    for size in sorted(merged, reverse=True):
        n = merged[size]
        while n:
            i = bisect_left(order, size)
            if i == len(order):
                each = min(n, capacity // size)
                put([size] * each, n // each)
                n %= each
                continue
            gap = order[i]
            lengths, have = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(i)
            each = min(gap // size, n)
            k = min(have, n // each)
            if have > k:
                put(lengths, have - k)
            put(lengths + [size] * each, k)
            n -= k * each
    return out + [x for g in order for x in gaps[g]]


def placements(kinds: list[tuple[list[int], int]], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """The plan as runs of ranks within each length, sorted by (length, first rank)."""
    nxt, first_sequence, rows = [0] * (capacity + 1), 0, []
    for lengths, n in kinds:
        offset = 0
        for size in sorted(set(lengths), reverse=True):
            each = lengths.count(size)
            rows.append((size, nxt[size], first_sequence, each, offset))
            nxt[size] += each * n
            offset += each * size
        first_sequence += n
    rows.sort()
    return dict(zip(("length", "rank", "sequence", "each", "offset"), np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each row's tokens and end token."""
    path = path or vocabulary_path()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, crc, step = encoder(path), zlib.crc32, 4 * capacity
        for b in batches:
            ids = b.column(0).to_pylist()
            for at, part in chunked(b.column(1)):
                rows = []
                for doc, data in zip(ids[at : at + len(part)], bpe.encode_batch(part, in_rounds=True), strict=True):
                    data += END
                    rows += [(doc, i, i * capacity, len(x) // 4, crc(x)) for i, x in enumerate(data[s : s + step] for s in range(0, len(data), step))]
                yield record_batch(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, chunk_rows: int | None = None) -> DataFrame:
    """pieces() with sequence_id and offset of each."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    cut = scratch.write(pieces(docs, path, capacity), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # at most capacity rows
        counts[length] = n
    found = placements(plan(counts, capacity), capacity)
    chunk_rows = chunk_rows or min(CHUNK_ROWS, max(1024, int(counts.sum()) // (4 * shuffle_partitions(spark))))
    chunks = -(-counts // chunk_rows)
    first = np.cumsum(chunks) - chunks  # number of each length's first chunk
    several = np.flatnonzero(chunks > 1)
    dealt = F.lit(0)
    if len(several):  # at most capacity numbers
        of = F.array(*(F.lit(int(n)) for n in np.maximum(chunks, 1)))
        dealt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(of, (F.col("length") + 1).cast("int"))).cast("int")
    cut = cut.withColumn("chunk", dealt)
    table_ = np.zeros(int(chunks.sum()), np.int64)
    table_[first[counts > 0]] = counts[counts > 0]
    if len(several):
        for length, chunk, n in cut.where(F.col("length").isin([int(x) for x in several])).groupBy("length", "chunk").count().collect():  # a row for each CHUNK_ROWS rows
            table_[first[length] + chunk] = n
    before = np.cumsum(table_) - table_
    before -= np.repeat(before[first[chunks > 0]], chunks[chunks > 0])  # ranks start at 0 in each length
    shared = spark.sparkContext.broadcast((first, before, found))
    w = W.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(w))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, before, p = shared.value
        keys = (p["length"] << 44) + p["rank"]
        for b in batches:
            if not b.num_rows:
                continue
            length, chunk, rank = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5, 6))
            rank = rank - 1 + before[first[length] + chunk]
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            own = rank - p["rank"][at]
            yield record_batch({"doc_id": b.column(0), "piece": b.column(1), "start": b.column(2), "length": b.column(3), "ids_crc32": b.column(4), "sequence_id": p["sequence"][at] + own // p["each"][at], "offset": p["offset"][at] + own % p["each"][at] * length}, schema)

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "chunk", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
