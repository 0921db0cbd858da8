"""SimHash near-duplicates with BK-trees.

A fingerprint takes the majority of each bit over the XXH64 values of a text's
word shingles.  Distinct fingerprints are sharded by pigeonhole: of BLOCKS parts
of the 64 bits, at least BLOCKS - radius are equal in any two fingerprints that
link, so each choice of that many parts is a shard key.  Within a shard a
BK-tree (children keyed by their Hamming distance to the parent) is built, and
each fingerprint follows only the edges within the radius.  Trees travel to the
tasks of their shard instead of to all tasks, since the number of fingerprints
grows with the corpus and has no bound that a broadcast would need.

A shard returns one star for each linked set, not all its pairs; the components
over all shards give the classes.  A shard of more than LARGE fingerprints is
not searched in one task: its members are dealt to finer shards by all choices
of the rest of the bits but RADIUS blocks of FINE bits.  Such a shard's members
differ in RADIUS * FINE bits only, so it has at most 2 ** 16 of them.

Null and wordless texts have fingerprint zero, which links like any other.
Repeated rows share a fingerprint; very long texts are hashed whole.  Null
doc_ids have no part in component_id, which is null if a class has no other.  An
empty table gives an empty result; other columns are not read, except by
fingerprinted(), which keeps them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, mix64, record_batch, shuffle_partitions, table, text_chunks, text_function
from .components import components

RADIUS, SHINGLE, SEED, BLOCKS = 4, 4, 42, 6
LARGE, FINE = 1 << 16, 4
_CHUNK, _FRONTIER = 1 << 20, 1 << 22


def majorities(hashes: list[np.ndarray]) -> np.ndarray:
    """Fingerprint (uint64) of each list of hashes: the bits set in over half of them."""
    counts = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    h = np.concatenate([hashes[i] for i in full])
    starts = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
    for bit in range(64):
        ones = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), starts)
        out[full] |= (2 * ones > counts[full]).astype(np.uint64) << np.uint64(bit)
    return out


def shingle_hashes(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included: A-Z lower-cased, words of non-white bytes joined by a space; a shorter text is one shingle."""
    digest, words = xxhash.xxh64_intdigest, text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([digest(joined, seed)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps[: len(words) - shingle] + 1).tolist()]
    ends = [*gaps[shingle - 1 :].tolist(), len(joined)]
    return np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends, strict=True)], np.uint64)


def simhashes(data: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Fingerprint (uint64) of each text."""
    return majorities([shingle_hashes(text, shingle, seed) for text in data])


class BkTree:
    """BK-tree over distinct fingerprints, built and searched one level at a time for all items at once."""

    def __init__(self, values: np.ndarray):
        self.values = values
        n = len(values)
        self.edge = np.full(n, -1, np.int64)  # parent * 65 + distance, of each node but the root
        items, parent = np.arange(1, n), np.zeros(max(n - 1, 0), np.int64)
        while len(items):
            edge = parent * 65 + np.bitwise_count(values[items] ^ values[parent]).astype(np.int64)
            _, first, inverse = np.unique(edge, return_index=True, return_inverse=True)
            self.edge[items[first]] = edge[first]
            rest = np.ones(len(items), bool)
            rest[first] = False
            parent = items[first][inverse][rest]  # the others go down to the new child
            items = items[rest]
        self.order = np.argsort(self.edge, kind="stable")
        self.sorted = self.edge[self.order]

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(index of query, node) pairs at a distance of at most radius, level by level."""
        if not len(self.values):
            return
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            near = d <= radius
            yield q[near], node[near]
            low = np.searchsorted(self.sorted, node * 65 + np.maximum(d - radius, 1))
            high = np.searchsorted(self.sorted, node * 65 + np.minimum(d + radius, 64), side="right")
            count = high - low
            q = np.repeat(q, count)
            ends = np.cumsum(count)
            node = self.order[np.repeat(low - ends + count, count) + np.arange(len(q))]


def linked(values: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All links (places of both ends) of distinct values, a few queries at a time so that no more than about _FRONTIER are held."""
    tree, n = BkTree(values), len(values)
    block = max(1, min(512, _FRONTIER // max(1, n)))
    for at in range(0, n, block):
        found = list(tree.within(values[at : at + block], radius))
        yield np.concatenate([q for q, _ in found]) + at, np.concatenate([node for _, node in found])


def nearest(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """One link of each value that has any to an earlier one: to the nearest of these."""
    found = []
    for a, b in linked(values, radius):
        a, b = a[b < a], b[b < a]
        order = np.lexsort((b, np.bitwise_count(values[a] ^ values[b]), a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.diff(a, prepend=-1))
        found.append((values[a[first]], values[b[first]]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def stars(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (value, smallest linked value) that connect what the links of distinct values connect."""
    n = len(values)
    root = np.arange(n)
    for a, b in linked(values, radius):
        while True:  # join the sets of both ends until each link lies in one set
            ra, rb = root[a], root[b]
            if (ra == rb).all():
                break
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root != root[root]).any():
                root = root[root]
    some = np.flatnonzero(root != np.arange(n))
    return values[some], values[root[some]]


def _key(values: np.ndarray, parts: tuple[tuple[int, int], ...]) -> np.ndarray:
    """The bits of parts (from, to) of each value, side by side."""
    key = np.zeros(len(values), np.uint64)
    for low, high in parts:
        key = (key << np.uint64(high - low)) | ((values >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1))
    return key


def choices(radius: int, blocks: int) -> list[tuple[tuple[int, int], ...]]:
    """Each choice of blocks - radius of the blocks of 64 bits."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return list(combinations(list(zip(cuts, cuts[1:], strict=False)), blocks - radius))


def finer(choice: tuple[tuple[int, int], ...], radius: int, width: int = FINE) -> list[tuple[tuple[int, int], ...]]:
    """A choice with each choice of all but radius of the blocks of `width` bits that the rest is cut into."""
    free = [bit for bit in range(64) if not any(low <= bit < high for low, high in choice)]
    pieces, at = [], 0
    while at < len(free):  # consecutive bits, at most `width` of them
        end = at + 1
        while end < len(free) and end - at < width and free[end] == free[end - 1] + 1:
            end += 1
        pieces.append((free[at], free[end - 1] + 1))
        at = end
    return [choice + more for more in combinations(pieces, max(0, len(pieces) - radius))]


def shard_keys(values: np.ndarray, radius: int, blocks: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the choice, key of each value) for each choice of blocks - radius of the blocks."""
    for k, choice in enumerate(choices(radius, blocks)):
        yield k, _key(values, choice)


Join = Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]]


def links(fingerprints: DataFrame, scratch: Scratch, radius: int = RADIUS, blocks: int = BLOCKS, join: Join = stars, large: int = LARGE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp long): with stars() they connect all within radius of each other, with nearest() they are links themselves."""
    keyed = pa.schema([("shard", pa.int64()), ("fp", pa.int64())])
    edge = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    coarse = choices(radius, blocks)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for k, choice in enumerate(coarse):
                yield record_batch({"shard": (_key(fp.view(np.uint64), choice) * np.uint64(64) + np.uint64(k)).view(np.int64), "fp": fp}, keyed)

    def deal_finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard, fp = (b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            for k in np.unique(shard % np.uint64(64)).tolist():
                own = shard % np.uint64(64) == k
                for n, choice in enumerate(finer(coarse[k], radius)):
                    key = mix64(_key(fp[own], choice) ^ mix64(np.full(1, (n << 8) + k + 1, np.uint64)))
                    yield record_batch({"shard": key.view(np.int64), "fp": fp[own].view(np.int64)}, keyed)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # pieces of the last shard, which may go on

        def solve() -> Iterator[pa.RecordBatch]:
            shard, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            cuts = np.flatnonzero(np.diff(shard)) + 1
            starts, ends = np.concatenate(([0], cuts)), np.append(cuts, len(shard))
            pairs = np.flatnonzero(ends - starts == 2)
            a, b = fp[starts[pairs]], fp[starts[pairs] + 1]
            near = (np.bitwise_count((a ^ b).view(np.uint64)) <= radius) & (a != b)  # of a signed number the bits of its size would be counted
            a, b = [a[near]], [b[near]]
            for i in np.flatnonzero(ends - starts > 2).tolist():
                x, y = join(np.unique(fp[starts[i] : ends[i]].view(np.uint64)), radius)
                a.append(x.view(np.int64))
                b.append(y.view(np.int64))
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                yield record_batch({"a": a, "b": b}, edge)

        for batch in batches:
            if not batch.num_rows:
                continue
            shard, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            last = int(np.searchsorted(shard, shard[-1]))
            if last or held and held[-1][0][-1] != shard[0]:
                if last:
                    held.append((shard[:last], fp[:last]))
                yield from solve()
                held = []
            held.append((shard[last:], fp[last:]))
        if held:
            yield from solve()

    def searched(dealt: DataFrame) -> DataFrame:
        dealt = dealt.repartition(shuffle_partitions(dealt.sparkSession), "shard").sortWithinPartitions("shard")
        return dealt.mapInArrow(search, "a long, b long")

    dealt = fingerprints.select("fp").mapInArrow(deal, "shard long, fp long")
    big = scratch.write(dealt.groupBy("shard").count().where(F.col("count") > large).select("shard"), "large_shards")
    if big.isEmpty():
        return searched(dealt).distinct()
    fine = dealt.join(big, "shard").mapInArrow(deal_finer, "shard long, fp long")
    return searched(dealt.join(big, "shard", "left_anti")).unionByName(searched(fine)).distinct()


def fingerprinted(docs: DataFrame, text_col: str = "text", out: str = "fp") -> DataFrame:
    """docs with a column of fingerprints as long (replacing one of that name).  Only the texts go to Python, and only the fingerprints come back."""

    def run(column: pa.Array) -> pa.Array:
        found = [simhashes(data) for _, _, data in text_chunks(column, _CHUNK)]
        return pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())

    return docs.withColumn(out, text_function(run, "long")(F.col(text_col)))


def classes(rows: DataFrame, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """(fp, root, component_id) of each distinct fingerprint of rows (doc_id, fp): component_id is the smallest doc_id that is reachable over links (null if all of them are null)."""
    least = scratch.write(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(least, scratch, radius), scratch)
    named = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    # the key is rewritten after the aggregate, so that a root that most rows share can be split (see components)
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id")).select(F.expr("root | 0L").alias("root"), "component_id")
    return scratch.write(named.join(smallest, "root").select("fp", "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of each row."""
    scratch = Scratch(docs.sparkSession)
    rows = fingerprinted(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "fp")
    rows = scratch.write(rows, "fingerprints")
    return rows.join(classes(rows, scratch, radius), "fp").select("doc_id", "fp", "component_id")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
