"""Document fingerprints: a homomorphic multiset hash of a text's paragraphs.

Each paragraph (a line; an empty text is one empty paragraph) hashes to a wide
vector: EXACT lanes from a cryptographic digest and LIKE lanes of signed counts
of its 16-byte windows.  A fingerprint is the lane-wise sum, modulo 2**16 in the
EXACT lanes and modulo 2**32 in the LIKE lanes, so the order of paragraphs does
not matter, and inserting or deleting paragraphs is an addition or subtraction of
their vectors.  The LIKE lanes are zero-mean, hence the cosine of two
fingerprints' LIKE lanes estimates how much of their paragraphs' content is
shared.  A text has less than 2**31 windows, so these lanes never wrap.

Null texts count as empty.  Rows are kept as they are: repeated rows and
repeated or null doc_ids each give a row.  Very long texts are hashed whole, one
at a time.  An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_sizes, record_batch, shuffle_partitions, slices, table, text_chunks, texts

EXACT, LIKE, WINDOW = 64, 256, 16
_PAD = b"\0" * (WINDOW - 1)
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_CHUNK = 2 << 20


def paragraph_sums(segments: list[bytes | None]) -> np.ndarray:
    """Sum of the paragraph vectors of each segment (paragraphs joined by newlines; None: no paragraph) as uint32 lanes (of the EXACT ones the lower halves count)."""
    out = np.zeros((len(segments), EXACT + LIKE), np.uint32)
    full = [i for i, s in enumerate(segments) if s is not None]
    if not full:
        return out
    digests, counts = [], []
    for i in full:
        parts = segments[i].split(b"\n")
        counts.append(len(parts))
        for p in parts:
            digests.append(hashlib.blake2b(p, digest_size=64, person=b"lanes-lo").digest())
            digests.append(hashlib.blake2b(p, digest_size=64, person=b"lanes-hi").digest())
    lanes = np.frombuffer(b"".join(digests), "<u2").reshape(-1, EXACT)
    starts = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
    out[full, :EXACT] = np.add.reduceat(lanes, starts, axis=0, dtype=np.uint32)
    padded = [segments[i].replace(b"\n", b"\n" + _PAD) + b"\n" + _PAD for i in full]
    lens = np.fromiter(map(len, padded), np.int64, len(full))
    buf = b"".join(padded) + b"\0" * WINDOW
    total = int(lens.sum())
    raw = np.frombuffer(buf, np.uint8)
    words = np.ndarray((total + WINDOW - 8,), "<u8", buf, strides=(1,))
    keep = np.flatnonzero((raw[:total] != 0) & (raw[:total] != 10))
    h = words[keep] * _K1
    h ^= (words[keep + 8] + _K3) * _K2
    h ^= h >> np.uint64(31)
    h *= _K3
    key = (h >> np.uint64(64 - 9)).astype(np.int64)
    key += np.repeat(np.arange(len(full), dtype=np.int64), lens)[keep] * (2 * LIKE)
    bins = np.bincount(key, minlength=len(full) * 2 * LIKE).reshape(len(full), 2, LIKE)
    out[full, EXACT:] = (bins[:, 0] - bins[:, 1]).astype(np.uint32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise likeness (0 to 1) of two arrays of lanes; 1 for equal ones."""
    x, y = (z[:, EXACT:].astype(np.uint32).view(np.int32).astype(np.float64) for z in (a, b))
    norm = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    cos = (x * y).sum(1) / np.where(norm > 0, norm, 1)
    same = (a[:, EXACT:] == b[:, EXACT:]).all(1) & (a[:, :EXACT].astype(np.uint16) == b[:, :EXACT].astype(np.uint16)).all(1)
    return np.where(same, 1.0, np.clip(cos, 0, 1))


def _hex(rows: np.ndarray) -> list[str]:
    return [r[:EXACT].astype("<u2").tobytes().hex() + r[EXACT:].astype("<u4").tobytes().hex() for r in rows]


def lanes_of(fingerprint: str) -> np.ndarray:
    """The lanes that a fingerprint spells out."""
    data = bytes.fromhex(fingerprint)
    return np.concatenate((np.frombuffer(data, "<u2", EXACT).astype(np.uint32), np.frombuffer(data, "<u4", LIKE, 2 * EXACT)))


def fingerprint_of(text: str) -> str:
    """Fingerprint of one text."""
    return _hex(paragraph_sums([text.encode()]))[0]


def add(fingerprint: str, inserted: list[str] = (), deleted: list[str] = ()) -> str:
    """Fingerprint after paragraphs were inserted and deleted."""
    lanes = lanes_of(fingerprint)
    for p in inserted:
        lanes += paragraph_sums([p.encode()])[0]
    for p in deleted:
        lanes -= paragraph_sums([p.encode()])[0]
    return _hex(lanes[None])[0]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and fingerprint of each row; other columns are not read."""
    schema = pa.schema([(id_col, pa.int64()), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, part in text_chunks(b.column(1), _CHUNK):
                yield record_batch({id_col: b.column(0).slice(i, j - i), "fingerprint": _hex(paragraph_sums(part))}, schema)

    return df.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, f"`{id_col}` long, fingerprint string")


def _edited_rows(rows: list[tuple], nexts: list[str]) -> dict:
    """Output columns of rows (doc_id, text) whose next texts are nexts.  The edit deletes the paragraphs from the cut on and inserts the new ones."""
    segments: list[bytes | None] = []
    edited, lengths = [], []
    for (_, text), nxt in zip(rows, nexts, strict=True):
        n = len(text)
        cut = n - n // 3
        new = text[:cut] + nxt[: n // 3]
        at = text.rfind("\n", 0, cut)
        segments += [text[:at].encode() if at >= 0 else None, text[at + 1 :].encode(), new[at + 1 :].encode()]
        edited.append(new)
        lengths.append(n)
    sums = paragraph_sums(segments)
    own = sums[0::3] + sums[1::3]
    new = own - sums[1::3] + sums[2::3]
    after = paragraph_sums([nexts[-1].encode()])
    return {
        "doc_id": [r[0] for r in rows],
        "n_chars": lengths,
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
        "fingerprint": _hex(own),
        "edited_fingerprint": _hex(new),
        "near_edited": likeness(own, new),
        "near_next": likeness(own, np.concatenate([own[1:], after])),
    }


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _dealer(keys: DataFrame, ranges: int) -> Callable[[pa.Array, pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Function from doc_ids and text hashes to (range, key that descends with the id, text hash); ranges follow each other in the order of rows.

    Ids that take several of the marks between ranges, and nulls, get as many
    ranges of their own, by the text hash.
    """
    marks = [i / ranges for i in range(1, ranges)]
    total, some, found = keys.agg(F.count(F.lit(1)), F.count("doc_id"), F.percentile_approx("doc_id", marks, 10 * ranges)).first()
    splits, times = np.unique(np.array(found or [], np.int64), return_counts=True)
    own = np.where(times > 1, times, 0)  # ranges of the split id itself, after the gap below it
    base = np.concatenate(([0], np.cumsum(own + 1)))  # number of the gap before each split, ascending
    last = int(base[-1]) + 1
    nulls = max(1, -(-(total - some) * ranges // max(1, total)))

    def share(order: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        high = (order.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
        return ((high * np.asarray(n, np.uint64)) >> np.uint64(32)).astype(np.int64)

    def deal(ids: pa.Array, orders: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = ids.is_null().to_numpy(zero_copy_only=False)
        x, order = ids.fill_null(0).to_numpy(zero_copy_only=False), np.ascontiguousarray(orders.to_numpy(zero_copy_only=False))
        at = np.searchsorted(splits, x, side="left")
        cell = base[at]
        if len(splits):
            i = np.minimum(at, len(splits) - 1)
            hot = (splits[i] == x) & (own[i] > 0)
            cell = np.where(hot, base[i] + own[i] - share(order, own[i]), cell)
        to = np.where(none, last + share(order, nulls), last - 1 - cell)
        return to, np.where(none, np.int64(2**63 - 1), ~x), order

    return deal


def edited_fingerprints(df: DataFrame) -> DataFrame:
    """Fingerprint of each text and of its edited text: the last third replaced by the start of the next document's text.

    Next is the next row by descending doc_id (nulls last; rows with equal ids by
    the hash of their text); the last row's next is the first.  Rows are dealt to
    about 8 ranges for each shuffle partition, by id; ids that many rows share
    (and null) are dealt further by the hash of the text.  The first row of a
    range is also sent to the range before it, so that the text is shuffled once
    and a task holds only the rows of one small chunk.
    """
    spark = df.sparkSession
    parts = shuffle_partitions(spark)
    keys = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("order"))
    deal = _dealer(keys, 8 * parts)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                to, down, order = deal(b.column(0), b.column(1))
                at = np.lexsort((order, down, to))
                at = at[np.flatnonzero(np.diff(to[at], prepend=-1))]
                yield pa.RecordBatch.from_pydict({"range": pa.array(to[at], pa.int32()), "down": pa.array(down[at], pa.int64()), "order": pa.array(order[at], pa.int64())})

    found = keys.mapInArrow(heads, "range int, down long, order long").groupBy("range").agg(F.min(F.struct("down", "order")).alias("h")).select("range", "h.*")
    tops = sorted(map(tuple, found.collect()))  # a row for each range
    n = 1 + max((r[0] for r in tops), default=0)
    before, head = np.full(n, -1, np.int32), np.zeros((2, n), np.int64)
    for i, (k, down, order) in enumerate(tops):
        before[k], head[:, k] = tops[i - 1][0], (down, order)  # the first range's head goes to the last range

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            to, down, order = deal(b.column(0), b.column(1))
            copies = np.flatnonzero((head[0, to] == down) & (head[1, to] == order))
            take = pa.array(np.concatenate([np.arange(len(to)), copies]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([to, before[to[copies]]]), pa.int32()), pa.array(np.arange(len(take)) >= len(to)), *(b.column(j).take(take) for j in range(3))],
                names=["range", "copy", "doc_id", "order", "text"],
            )

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("order"), "text")
    rows = rows.mapInArrow(dealt, "range int, copy boolean, doc_id long, order long, text string")
    rows = rows.repartition(parts, "range").sortWithinPartitions("range", "copy", F.desc_nulls_last("doc_id"), "order")
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (doc_id, text) of one range that wait for their next
        size, now, closed = 0, None, False
        for batch in batches:
            for i, j in slices(byte_sizes(batch.column(4)).tolist(), _CHUNK):
                b = batch.slice(i, j - i)
                for k, copy, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), texts(b.column(4)), strict=True):
                    if k != now:
                        now, closed = k, False
                    if copy and closed:
                        continue
                    if held and (copy or size > _CHUNK):
                        yield record_batch(_edited_rows(held, [t for _, t in held[1:]] + [text]), schema)
                        held, size = [], 0
                    closed = copy
                    if not copy:
                        held.append((doc, text))
                        size += len(text)

    return rows.mapInArrow(walk, OUT)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
