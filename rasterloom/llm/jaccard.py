"""Near copies by the exact similarity of word shingles, found by SimHash BK-trees and min-hash buckets.

A text's set holds the XXH64 values of its five-word shingles (A-Z lower-cased,
words of non-white bytes; shorter texts are one shingle).  Texts link if the
Jaccard similarity of their sets is at least 4/5, and the components over the
links are the classes.  Null and wordless texts have the empty set, which only
equals itself.  Texts with equal sets (told by XXH64 over the sorted set) are
one node from the start.

Every link is verified exactly on the texts.  Candidates come in three passes,
each of which takes no pair within a component that the ones before made:

1. The SimHash operator's BK-trees over 64-bit fingerprints of the sets: each
   fingerprint's nearest one within RADIUS bits.
2. The cheapest forest of the possible links in each min-hash bucket.
3. All possible links between components in each bucket.

A radius that a pigeonhole can serve reaches few of the pairs near 0.8: these
differ in about 10 of 64 bits.  So the last two passes decide what is found: of
BANDS keys of ROWS minima a pair at the threshold shares none with a probability
of (1 - 0.8 ** 5) ** 40, about 1.3e-7, and less above it.  A parity sketch bounds
the difference of two sets from below, so it takes pairs out without losing one.

Repeated rows are one node; rows are kept whole, with columns of any name.  Very
long texts are shingled whole.  Null doc_ids come last.  An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import Scratch, byte_sizes, free_name, mix64, quoted, record_batch, shuffle_partitions, slices, text_chunks, text_function, utf8
from .components import components

SHINGLE, SEED, BANDS, ROWS, WORDS = 5, 42, 40, 5, 8  # WORDS of 64 bits in a sketch
RADIUS, BLOCKS = 4, 6  # of the BK-trees
_CHUNK = 1 << 20
_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(simhash.shingle_hashes(text, SHINGLE, SEED))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets' Jaccard similarity is at least 4/5."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """BANDS keys of each set; no set may be empty."""
    h, starts = np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band, np.uint64)
        for k in range(band * ROWS, band * ROWS + ROWS):
            key = mix64(key ^ np.minimum.reduceat(h * _TIMES[k] + _PLUS[k], starts))
        out[:, band] = key
    return out


def sketch(values: np.ndarray) -> np.ndarray:
    """Parity of the number of values at each of 64 * WORDS bits: sketches differ in at most as many bits as sets in values."""
    odd = np.bincount((values >> np.uint64(20)).astype(np.int64) % (64 * WORDS), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def slack(sketches: np.ndarray, sizes: np.ndarray, i: int) -> np.ndarray:
    """Least possible difference of set i from each set, over the largest that still links: no links above 1."""
    apart = np.maximum(np.bitwise_count(sketches ^ sketches[i]).sum(1, dtype=np.int64), np.abs(sizes - sizes[i]))
    return 9 * apart / (sizes + sizes[i])


def forest(sketches: np.ndarray, sizes: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between components of the cheapest forest of the possible links (Prim's algorithm, no matrix is held; within a component steps are free)."""
    n = len(sizes)
    best, parent, left = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    a, b, now = [], [], 0
    for _ in range(n - 1):
        left[now] = False
        best[now] = np.inf
        cost = np.where(roots == roots[now], -1.0, slack(sketches, sizes, now))
        nearer = left & (cost < best)
        best[nearer], parent[nearer] = cost[nearer], now
        now = int(np.argmin(best))
        if 0 <= best[now] <= 1:
            a.append(parent[now])
            b.append(now)
    return np.array(a, np.int64), np.array(b, np.int64)


def crossing(sketches: np.ndarray, sizes: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All possible links between members of different components."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if (roots != roots[0]).any():
        for i in range(len(sizes) - 1):
            found = i + 1 + np.flatnonzero((slack(sketches[i:], sizes[i:], 0)[1:] <= 1) & (roots[i + 1 :] != roots[i]))
            a.append(np.full(len(found), i))
            b.append(found)
    return np.concatenate(a), np.concatenate(b)


_MARKS = [("set", pa.int64()), ("size", pa.int64()), ("fp", pa.int64()), ("sketch", pa.binary()), ("bands", pa.binary())]


def marks(column: pa.Array) -> pa.Array:
    """set, size, fp (the SimHash of the set), sketch and bands (empty for the empty set) of each text."""
    out: dict[str, list] = {name: [] for name, _ in _MARKS}
    for _, _, data in text_chunks(column, _CHUNK):
        sets = [shingles(x) for x in data]
        full = [k for k, s in enumerate(sets) if len(s)]
        keys = [b""] * len(sets)
        if full:
            for k, row in zip(full, bands([sets[k] for k in full]), strict=True):
                keys[k] = row.tobytes()
        out["set"].append(np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64))
        out["size"].append(np.array([len(s) for s in sets], np.int64))
        out["fp"].append(simhash.majorities(sets).view(np.int64))
        out["sketch"] += [sketch(s).tobytes() for s in sets]
        out["bands"] += keys
    for name in ("set", "size", "fp"):
        out[name] = np.concatenate(out[name]) if out[name] else np.zeros(0, np.int64)
    return pa.StructArray.from_arrays([pa.array(out[name], kind) for name, kind in _MARKS], names=[name for name, _ in _MARKS])


def marked(docs: DataFrame, mark: str, row: str) -> DataFrame:
    """docs with marks() of the text in a column mark and a row number in row.  Only the texts go to Python."""
    made = text_function(marks, "`set` long, size long, fp long, sketch binary, bands binary")
    return docs.withColumn(mark, made(F.col("text"))).withColumn(row, F.monotonically_increasing_id())


def bk_pairs(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct pairs (a, b) of sets (set, fp) with equal fingerprints, or with one that is another's nearest within RADIUS bits."""
    heads = scratch.write(sets.groupBy("fp").agg(F.min("set").alias("head")), "heads")
    same = sets.join(heads, "fp").where(F.col("set") != F.col("head")).select(F.col("head").alias("x"), F.col("set").alias("y"))
    near = simhash.links(heads, scratch, RADIUS, BLOCKS, simhash.nearest)
    near = near.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
    return same.unionByName(near.select("x", "y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def members(sets: DataFrame) -> DataFrame:
    """(key, set) of each bucket that two sets (set, bands) share at least."""
    kept = pa.schema([("key", pa.int64()), ("set", pa.int64())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = b.column(1).to_pylist()
            count = [len(x) // 8 for x in found]
            yield record_batch({"key": np.frombuffer(b"".join(found), np.int64), "set": np.repeat(b.column(0).to_numpy(zero_copy_only=False), count)}, kept)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, item, again = np.zeros(0, np.int64), np.zeros(0, np.int64), False  # the last row, and whether it shares its key with the one before
        for b in batches:
            key = np.concatenate((key, b.column(0).to_numpy(zero_copy_only=False)))
            item = np.concatenate((item, b.column(1).to_numpy(zero_copy_only=False)))
            same = key[1:] == key[:-1]
            keep = np.concatenate(([again], same))[:-1] | same
            yield record_batch({"key": key[:-1][keep], "set": item[:-1][keep]}, kept)
            again = bool(same[-1]) if len(same) else again
            key, item = key[-1:], item[-1:]
        if again:
            yield record_batch({"key": key, "set": item}, kept)

    dealt = sets.select("set", "bands").mapInArrow(deal, "key long, set long")
    return dealt.repartition(shuffle_partitions(sets.sparkSession), "key").sortWithinPartitions("key").mapInArrow(shared, "key long, set long")


def candidates(rows: DataFrame, all_crossing: bool) -> DataFrame:
    """Distinct pairs (a, b) of possible links in the buckets of rows (key, set, size, sketch, root): a forest of each, or all between components."""
    edge = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # pieces of the last bucket, which may go on

        def solve(key: np.ndarray, item: np.ndarray, size: np.ndarray, bits: np.ndarray, root: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero(np.diff(key)) + 1
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                x, y = crossing(bits[s:e], size[s:e], root[s:e]) if all_crossing else forest(bits[s:e], size[s:e], root[s:e])
                a.append(item[s:e][x])
                b.append(item[s:e][y])
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                yield record_batch({"a": np.minimum(a, b), "b": np.maximum(a, b)}, edge)

        for batch in batches:
            if not batch.num_rows:
                continue
            key, item, size, root = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4))
            now = [key, item, size, np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(-1, WORDS), root]
            last = int(np.searchsorted(key, key[-1]))
            if last:
                held.append([x[:last] for x in now])
            if held and held[-1][0][-1] != key[-1]:
                yield from solve(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
            held.append([x[last:] for x in now])
        if held:
            yield from solve(*(np.concatenate(x) for x in zip(*held, strict=True)))

    dealt = rows.select("key", "set", "size", "sketch", "root").repartition(shuffle_partitions(rows.sparkSession), "key")
    return dealt.sortWithinPartitions("key").mapInArrow(search, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose texts (set, text) are similar."""
    edge = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices((byte_sizes(batch.column(2)) + byte_sizes(batch.column(3))).tolist(), _CHUNK):
                b = batch.slice(i, j - i)
                ok = np.array([similar(shingles(x), shingles(y)) for x, y in zip(utf8(b.column(2)), utf8(b.column(3)), strict=True)], bool)
                yield record_batch({"a": b.column(0).to_numpy(zero_copy_only=False)[ok], "b": b.column(1).to_numpy(zero_copy_only=False)[ok]}, edge)

    both = pairs.join(texts.select(F.col("set").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("set").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def representatives(docs: DataFrame) -> DataFrame:
    """One whole row of docs of each class: that with the smallest doc_id (nulls last, then by set and row)."""
    scratch = Scratch(docs.sparkSession)
    mark, number = free_name(docs.columns, "__mark"), free_name(docs.columns, "__row")
    rows = scratch.write(marked(docs, mark, number), "rows")
    choice = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("doc_id"), F.col(f"{mark}.set").alias("set"), F.col(number).alias("row"))
    first = scratch.write(rows.groupBy(F.col(f"{mark}.set").alias("set")).agg(F.min(choice).alias("x")).select("x.*"), "sets")
    sets = rows.select(F.col(number).alias("row"), f"{mark}.*").join(first.select("row"), "row", "left_semi").select("set", "size", "fp", "sketch", "bands")
    shared = scratch.write(members(sets), "members")
    pairs = scratch.write(bk_pairs(sets.where("size > 0").select("set", "fp"), scratch), "bk_pairs")
    known = shared.select("set").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("set"))).distinct()
    texts = rows.select(F.col(number).alias("row"), "text").join(first.select("row", "set"), "row").join(known, "set", "left_semi")
    texts = scratch.write(texts.select("set", "text"), "texts")
    links = scratch.write(verified(pairs, texts), "bk_links")
    light = shared.join(sets.select("set", "size", "sketch"), "set")
    for all_crossing in (False, True):
        roots = scratch.write(components(links, scratch, f"roots{all_crossing}").withColumnRenamed("node", "set"), f"placed{all_crossing}")
        placed = light.join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
        links = links.unionByName(scratch.write(verified(candidates(placed, all_crossing), texts), f"links{all_crossing}"))
    roots = components(links, scratch, "classes").withColumnRenamed("node", "set")
    best = first.join(roots, "set", "left").groupBy(F.coalesce("root", "set").alias("root")).agg(F.min(F.struct("none", "doc_id", "set", "row")).alias("x"))
    return rows.join(best.select(F.col("x.row").alias(number)), number, "left_semi").select(*(F.col(quoted(c)) for c in docs.columns))
