"""Substring dedup with a log-structured index of window hashes.

Every run of `window` words that occurs twice shares all its inner word grams,
so also its minimiser: the smallest hash among its `gram`-word grams.  The index
keeps the hashes of those minimisers (about one position in thirteen), counted,
in sorted immutable runs on the shared folder.  A new batch becomes a run of its
own, is merge-joined with the earlier runs to find the hashes that repeat, and
runs of one level are compacted into one of the next.  Windows whose minimiser
repeats are then verified by a 128-bit digest of their exact words, so no
repeated window is lost and none is removed by a mere hash collision.

The index can stay: SubstringIndex on a folder of one's own keeps its runs and
the texts (compressed, with their anchors) of each batch, so that a later call
finds what its documents repeat of all earlier ones.

Null texts have no words.  Repeated rows are copies of each other: all their
windows repeat.  Documents of under `window` words keep everything.  An empty
table gives an empty result; other columns are not read, or kept by cleaned()
whatever their names.  Of a very long text a task holds its bytes, 32 bytes a
word and the hash tables of one piece of _PIECE bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORKER_CACHES, Folder, Scratch, free_name, mix64, quoted, record_batch, table, text_chunks, text_function

WINDOW, GRAM = 35, 12
BATCHES, FANOUT = 3, 2  # of a call without a history: the first two runs are compacted, and the third meets the compacted one
_CHUNK, _PIECE = 1 << 20, 1 << 21
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    WORKER_CACHES["powers"] = _powers.clear
    got = _powers.get(base)
    if got is None or len(got) < n:
        steps = np.full(max(n, _PIECE + 1), base, np.uint64)
        steps[0] = 1
        got = _powers[base] = np.multiply.accumulate(steps)
    return got


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of words joined by one space."""
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    return np.concatenate(([0], gaps + 1)), np.append(gaps, len(data))


def _sliding(a: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each `width` neighbours."""
    op, span = (np.minimum if least else np.maximum), 1
    while span * 2 <= width:
        a = op(a[:-span], a[span:])
        span *= 2
    return op(a[: len(a) - (width - span)], a[width - span :]) if width > span else a


def gram_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the bytes of each `gram` consecutive words, from prefix sums of a polynomial modulo 2**64 over pieces of about _PIECE bytes."""
    n = len(starts) - gram + 1
    out, at = np.empty(n, np.uint64), 0
    while at < n:
        base = starts[at]
        to = min(n, max(at + 1, int(np.searchsorted(ends, base + _PIECE, side="right")) - gram + 1))
        s, e = starts[at:to] - base, ends[at + gram - 1 : to + gram - 1] - base
        raw = np.frombuffer(data, np.uint8, int(e[-1]), int(base)).astype(np.uint64)
        raw += np.uint64(1)
        raw *= _power_table(_BASE, len(raw))[: len(raw)]
        sums = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(raw)))
        out[at:to] = (sums[e] - sums[s]) * _power_table(_INVERSE, len(raw) + 1)[s]
        at = to
    return mix64(out)


def minimisers(data: bytes, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each gram, minimum of each window); both empty if there is no window."""
    starts, ends = word_bounds(data)
    if len(starts) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h = gram_hashes(data, starts, ends, gram)
    return h, _sliding(h, window - gram + 1, True)


def anchors(data: bytes, window: int, gram: int) -> np.ndarray:
    """Hashes of all gram positions that are the minimum of a window (ties: each of them), as int64."""
    h, least = minimisers(data, window, gram)
    if not len(h):
        return np.zeros(0, np.int64)
    width = window - gram + 1
    edge = np.zeros(width - 1, np.uint64)
    most = _sliding(np.concatenate((edge, least, edge)), width, False)
    return h[most == h].view(np.int64)


def normalised(text: bytes) -> bytes:
    """Words joined by one space (bytes.split() cuts at exactly \\x20 and \\x09-\\x0D)."""
    return b" ".join(text.split())


def content_key(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


class SubstringIndex:
    """Sorted immutable runs (h, n) of anchor hashes and how often each occurred.

    A run is named by its level and the first and last batch that it holds.  In a
    folder that is no Scratch the index outlives the call: it then also keeps each
    batch's distinct texts (key, data, copies, hs), and opening the folder again
    goes on from there.  A batch counts as soon as its run is written; what a lost
    driver left half done is written anew, and runs that a wider one holds go.
    """

    def __init__(self, folder: Folder, window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT):
        self.folder, self.window, self.gram, self.fanout = folder, window, gram, fanout
        self.stays = not isinstance(folder, Scratch)
        self.runs: list[tuple[int, str, DataFrame]] = []  # level, name, run; in the order of their batches
        self.repeats: list[DataFrame] = []
        if self.stays:
            found = [self._span(n) for n in folder.names() if n.startswith("run-")]
            held = [x for x in found if any(y[0] > x[0] and y[1] <= x[1] and x[2] <= y[2] for y in found)]
            for x in held:
                folder.drop(self._name(*x))
            for x in sorted({*found} - {*held}, key=lambda x: x[1]):
                self.runs.append((x[0], self._name(*x), folder.read(self._name(*x))))
        self.made = self.history = max((self._span(x[1])[2] for x in self.runs), default=0)

    @staticmethod
    def _name(level: int, first: int, last: int) -> str:
        return f"run-{level}-{first}-{last}"

    @staticmethod
    def _span(name: str) -> tuple[int, int, int]:
        """Level, first and last batch of a run."""
        return tuple(map(int, name.split("-")[1:]))

    def _write(self, counts: DataFrame, level: int, first: int, last: int) -> DataFrame:
        name = self._name(level, first, last)
        run = self.folder.write(counts.sortWithinPartitions("h"), name)
        self.runs.append((level, name, run))
        return run

    def append(self, docs: DataFrame, text_col: str = "text") -> None:
        """Add a batch; `repeated` then also has the hashes that the batch repeats, its own or earlier ones."""
        window, gram = self.window, self.gram
        schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for _, _, data in text_chunks(b.column(0), _CHUNK, "powers"):
                    found = [anchors(normalised(t), window, gram) for t in data]
                    h, n = np.unique(np.concatenate(found), return_counts=True)
                    if len(h):
                        yield record_batch({"h": h, "n": n}, schema)

        self.made += 1
        if self.stays:
            self.folder.write(distinct_texts(docs.select(text_col), window, gram, True), f"texts-{self.made}")
        earlier = [run for _, _, run in self.runs]
        counts = docs.select(text_col).mapInArrow(emit, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
        run = self._write(counts, 0, self.made, self.made)
        known = run.where("n > 1").select("h")
        for old in earlier:
            known = known.unionByName(run.select("h").hint("merge").join(old.select("h"), "h"))
        self.repeats.append(self.folder.write(known, f"repeats-{self.made}"))
        self.compact()

    def compact(self) -> None:
        """Merge the runs of each level that has `fanout` of them."""
        for level in range(1 + max((x[0] for x in self.runs), default=0)):
            full = [x for x in self.runs if x[0] == level]
            if len(full) < self.fanout:
                continue
            self.runs = [x for x in self.runs if x[0] != level]
            union = full[0][2]
            for x in full[1:]:
                union = union.unionByName(x[2])
            self._write(union.groupBy("h").agg(F.sum("n").alias("n")), level + 1, self._span(full[0][1])[1], self._span(full[-1][1])[2])
            for x in full:
                self.folder.drop(x[1])
        self.runs.sort(key=lambda x: self._span(x[1])[1])

    def repeated(self) -> DataFrame:
        """Distinct anchor hashes that this object's batches repeat, their own or earlier ones."""
        out = self.repeats[0]
        for x in self.repeats[1:]:
            out = out.unionByName(x)
        return out.distinct()

    def earlier_texts(self) -> DataFrame | None:
        """(key, data, copies, hs) of the batches before this object's; None if there are none."""
        out = None
        for n in range(1, self.history + 1):
            x = self.folder.read(f"texts-{n}")
            out = x if out is None else out.unionByName(x)
        return out

    def close(self) -> None:
        """Drop what only this call needs: the lists of repeats, and the runs unless they stay."""
        for name in self.folder.names():
            if name.startswith("repeats-") or not self.stays and name.startswith("run-"):
                self.folder.drop(name)


def distinct_texts(text: DataFrame, window: int, gram: int, with_anchors: bool) -> DataFrame:
    """(key, data, copies) of each distinct word sequence of window words or more; hs: its distinct anchors, if asked for."""
    schema = pa.schema([("key", pa.binary()), ("data", pa.binary())] + [("hs", pa.list_(pa.int64()))] * with_anchors)

    def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1).compress
        for b in parts:
            for _, _, data in text_chunks(b.column(0), _CHUNK, "powers"):
                words = [w for w in map(normalised, data) if w.count(b" ") + 1 >= window]
                if words:
                    out = {"key": list(map(content_key, words)), "data": list(map(zip_, words))}
                    yield record_batch(out | ({"hs": [np.unique(anchors(w, window, gram)) for w in words]} if with_anchors else {}), schema)

    found = text.mapInArrow(packed, "key binary, data binary" + ", hs array<long>" * with_anchors)
    return found.groupBy("key").agg(F.first("data").alias("data"), F.count(F.lit(1)).alias("copies"), *([F.first("hs").alias("hs")] * with_anchors))


def _marked(n_words: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of starts."""
    delta = np.zeros(n_words + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + window, -1)
    return np.cumsum(delta[:-1]) > 0


def repeated_spans(docs: DataFrame, scratch: Scratch, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, text_col: str = "text", index: SubstringIndex | None = None) -> DataFrame:
    """One row for each distinct word sequence of docs that holds a repeated window: key, data (zstd of its words joined by a space), copies, starts (of repeated windows).

    key is content_key() of the words.  Texts are taken in `batches` through the
    index, dealt by a hash of the text.  With an index that has a history, windows
    that an earlier batch holds repeat, too.
    """
    index = index or SubstringIndex(scratch, window, gram)
    window, gram = index.window, index.gram
    for k in range(batches):
        index.append(docs.where(F.pmod(F.xxhash64(text_col), F.lit(batches)) == k), text_col)
    hit_schema = pa.schema([("key", pa.binary()), ("h", pa.int64())])

    def hits(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for _, _, data in text_chunks(b.column(0), _CHUNK, "powers"):
                words = {normalised(t) for t in data}
                found = [(content_key(t), np.unique(anchors(t, window, gram))) for t in words]
                keys = [k for k, h in found for _ in range(len(h))]
                if keys:
                    yield record_batch({"key": keys, "h": np.concatenate([h for _, h in found])}, hit_schema)

    # Both sides of the joins below come straight from an exchange (the right one
    # is a written table), so that adaptive execution can split a very common hash
    # or window over many tasks; an aggregate in between would forbid that.
    text = docs.select(text_col)
    repeated = scratch.write(index.repeated(), "repeated")
    mine = text.mapInArrow(hits, "key binary, h long").join(repeated, "h").groupBy("key").agg(F.collect_set("h").alias("hs"))
    some = distinct_texts(text, window, gram, False).join(mine, "key").withColumn("own", F.lit(True))
    if (older := index.earlier_texts()) is not None:
        theirs = older.select("key", F.explode("hs").alias("h")).join(repeated, "h").groupBy("key").agg(F.collect_set("h").alias("hs"))
        old = older.select("key", "data", "copies").join(theirs, "key").withColumn("own", F.lit(False))
        some = some.unionByName(old).groupBy("key").agg(F.first("data").alias("data"), F.sum("copies").alias("copies"), F.flatten(F.collect_set("hs")).alias("hs"), F.bool_or("own").alias("own"))
    some = scratch.write(some.withColumn("id", F.monotonically_increasing_id()), "candidates")
    index.close()
    window_schema = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("id", pa.int64()), ("start", pa.int32()), ("n", pa.int64())])

    def windows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        blake = hashlib.blake2b
        for b in parts:
            for i in range(b.num_rows):
                id_, data, copies, hs = (b.column(k)[i].as_py() for k in range(4))
                data = unzip(data)
                starts, ends = word_bounds(data)
                _, least = minimisers(data, window, gram)
                at = np.flatnonzero(np.isin(least.view(np.int64), np.array(hs, np.int64)))
                cuts = zip(starts[at].tolist(), ends[at + window - 1].tolist(), strict=True)
                digest = np.frombuffer(b"".join([blake(data[s:e], digest_size=16).digest() for s, e in cuts]), np.int64).reshape(-1, 2)
                if len(at):
                    yield record_batch({"w1": digest[:, 0].copy(), "w2": digest[:, 1].copy(), "id": np.full(len(at), id_), "start": at.astype(np.int32), "n": np.full(len(at), copies)}, window_schema)

    each = some.select("id", "data", "copies", "hs").mapInArrow(windows, "w1 long, w2 long, id long, start int, n long")
    twice = scratch.write(each.groupBy("w1", "w2").agg(F.sum("n").alias("total")).where("total > 1").select("w1", "w2"), "twice")
    starts = each.drop("n").join(twice, ["w1", "w2"]).groupBy("id").agg(F.collect_list("start").alias("starts"))
    return some.where("own").drop("hs", "own").join(starts, "id").select("key", "data", "copies", "starts")


def removals(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, index: SubstringIndex | None = None) -> DataFrame:
    """op2's columns for each row of docs (doc_id, text); with an index, repeats of its earlier batches count."""
    scratch = Scratch(docs.sparkSession)
    window = index.window if index else window
    kept_schema = pa.schema([("key", pa.binary()), ("removed", pa.int64()), ("kept", pa.string())])

    def light(column: pa.Array) -> pa.Array:
        keys, counts, digests = [], [], []
        for _, _, data in text_chunks(column, _CHUNK, "powers"):
            for words in map(normalised, data):
                keys.append(content_key(words))
                counts.append(words.count(b" ") + 1 if words else 0)
                digests.append(hashlib.sha256(words).hexdigest())
        return pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(digests, pa.string())], names=["key", "n_words", "sha"])

    def kept(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        for b in parts:
            out = {"key": [], "removed": [], "kept": []}
            for i in range(b.num_rows):
                key, data, starts = (b.column(k)[i].as_py() for k in range(3))
                words = unzip(data).split(b" ")
                gone = _marked(len(words), np.array(starts, np.int64), window)
                out["key"].append(key)
                out["removed"].append(int(gone.sum()))
                out["kept"].append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])).hexdigest())
            if out["key"]:
                yield record_batch(out, kept_schema)

    found = repeated_spans(docs, scratch, window, gram, 1 if index else BATCHES, index=index).select("key", "data", "starts").mapInArrow(kept, "key binary, removed long, kept string")
    read = text_function(light, "key binary, n_words long, sha string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), read("text").alias("x")).select("doc_id", "x.*")
    return rows.join(found, "key", "left").select("doc_id", "n_words", F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "sha").alias("kept_sha256"))


_PIECES = re.compile(rb"[\x20\x09-\x0d]*[^\x20\x09-\x0d]+")


def cut_out(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the words that are gone, each with the white space before it."""
    pieces = _PIECES.findall(text)
    tail = text[sum(map(len, pieces)) :]
    kept = b"".join([p for p, g in zip(pieces, gone.tolist(), strict=True) if not g])
    return (kept.lstrip(b" \t\n\r\x0b\x0c") if len(gone) and gone[0] else kept) + tail


def cleaned(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with the words in repeated windows cut out of text, and n_chars following it; rows that lose all their words go, others stay as they are.

    Only texts go to Python; of the second pass only those that change come back.
    """
    scratch = Scratch(docs.sparkSession)

    def keys(column: pa.Array) -> pa.Array:
        return pa.array([content_key(normalised(t)) for _, _, data in text_chunks(column, _CHUNK, "powers") for t in data], pa.binary())

    def cut(column: pa.Array, starts: pa.Array) -> pa.Array:
        texts_, chars, keep = [], [], []
        for i, j, data in text_chunks(column, _CHUNK, "powers"):
            for text, at in zip(data, starts.slice(i, j - i).to_pylist(), strict=True):
                gone = _marked(len(text.split()), np.array(at or [], np.int64), window)
                new = cut_out(text, gone).decode() if at else None
                texts_.append(new)
                chars.append(None if new is None else len(new))
                keep.append(not at or not gone.all())
        return pa.StructArray.from_arrays([pa.array(texts_, pa.string()), pa.array(chars, pa.int64()), pa.array(keep, pa.bool_())], names=["text", "chars", "keep"])

    own = docs.columns
    key, starts, new = (free_name(own, n) for n in ("__key", "__starts", "__new"))
    spans = scratch.write(repeated_spans(docs, scratch, window, gram).select(F.col("key").alias(key), F.col("starts").alias(starts)), "spans")
    rows = docs.withColumn(key, text_function(keys, "binary")(F.col("text"))).join(spans, key, "left")
    changed = F.col(starts).isNotNull()
    rows = rows.withColumn(new, text_function(cut, "text string, chars long, keep boolean")(F.when(changed, F.col("text")), F.col(starts))).where(F.col(f"{new}.keep"))
    made = {"text": F.when(changed, F.col(f"{new}.text")).otherwise(F.col("text"))}
    if "n_chars" in own:
        made["n_chars"] = F.when(changed, F.col(f"{new}.chars").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return rows.select(*(made.get(c, F.col(quoted(c))).alias(c) for c in own))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents"))
