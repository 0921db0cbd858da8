"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else is one separator; n-grams of ORDERS
characters hash to BUCKETS.  Counts are gathered over all training rows in
Spark; the log-probability matrix (languages x BUCKETS, so bounded by the number
of languages) goes to every task and batches are scored sparsely in numpy.

Null texts and texts without a letter get `und` with score 0, as does everything
if there is no training row.  Ties go to the language that sorts first.  The
score is the posterior of the predicted language after the evidence is scaled to
at most EVIDENCE n-grams.  Very long texts are scored whole, one at a time.  An
empty table gives an empty result and learns nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, quoted, record_batch, table, text_chunks, text_function

ORDERS, BUCKETS, EVIDENCE, SMOOTHING = (1, 2, 3), 1 << 15, 40, 0.5
#: Bound of the model (languages x BUCKETS 4-byte numbers, 64 MB); more are refused, not cut.
MAX_LANGUAGES, HELD_LANGUAGES = 500, 64
_CHUNK = 1 << 19
_MULT = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F)]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point to itself if a letter, else 0."""
    out = np.arange(0x110000, dtype=np.uint32)
    out[[i for i in range(0x110000) if not chr(i).isalpha()]] = 0
    return out


def ngrams(batch: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the bucket of the n-gram at each character; start of each text among them; whether a text has letters.  Each text begins with separators of its own, so n-grams never cross texts."""
    gap = " " * max(ORDERS)
    joined = gap + gap.join(batch) + gap
    low = joined.lower()
    if len(low) != len(joined):  # a few letters grow when lower-cased
        low = gap + gap.join(t.lower() for t in batch) + gap
        lens = [len(t.lower()) for t in batch]
    else:
        lens = list(map(len, batch))
    chars = _letters()[np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")]
    starts = np.concatenate(([0], np.cumsum(np.array(lens, np.int64) + len(gap))[:-1])).astype(np.int64)
    keep = (chars != 0) | (np.roll(chars, -1) != 0)  # separators count only before a letter
    keep[-1] = chars[-1] != 0
    out = []
    for order in ORDERS:
        h = chars * _MULT[0]
        for k in range(1, order):
            h = (h ^ (h >> np.uint32(15))) * _MULT[k] + np.roll(chars, -k)
        h = (h ^ (h >> np.uint32(13))) * _MULT[3] + np.uint32(order)
        out.append(((h >> np.uint32(16)) % np.uint32(BUCKETS)).astype(np.int64))
    has = np.add.reduceat(chars != 0, starts, dtype=np.int64) > 0
    return [np.where(keep, x, BUCKETS) for x in out], starts, has


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities with a zero column for separators) from all rows with a text and a language."""
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(1).to_pylist()
            for i, j, data in text_chunks(b.column(0), _CHUNK):
                grams, starts, _ = ngrams([t.decode() for t in data])
                names = sorted(set(langs[i:j]))
                which = np.repeat(np.array([names.index(x) for x in langs[i:j]]), np.diff(starts, append=len(grams[0])))
                for g in grams:
                    bins = np.bincount(which * (BUCKETS + 1) + g, minlength=len(names) * (BUCKETS + 1)).reshape(-1, BUCKETS + 1)
                    for name, row in zip(names, bins, strict=True):
                        total[name] = total[name] + row if name in total else row
                if len(total) > HELD_LANGUAGES:  # a task's memory does not follow the number of languages
                    yield from out(total)
                    total = {}
        yield from out(total)

    def out(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, row in total.items():
            at = np.flatnonzero(row[:BUCKETS])
            yield record_batch({"lang": [name] * len(at), "bucket": at, "n": row[at]}, schema)

    known = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col, lang_col)
    languages = known.select(lang_col).distinct().limit(MAX_LANGUAGES + 1).count()
    if languages > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: the model would not fit in each task")
    sums = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(sums.column("lang").to_pylist()))
    matrix = np.zeros((len(langs), BUCKETS + 1))
    at = {x: i for i, x in enumerate(langs)}
    matrix[[at[x] for x in sums.column("lang").to_pylist()], sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    if len(langs):
        matrix[:, :BUCKETS] += SMOOTHING
        matrix[:, :BUCKETS] = np.log(matrix[:, :BUCKETS] / matrix[:, :BUCKETS].sum(1, keepdims=True))
    return langs, np.ascontiguousarray(matrix.T.astype(np.float32))


def predict(batch: list[str], langs: list[str], matrix: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    if not langs:
        return ["und"] * len(batch), np.zeros(len(batch))
    grams, starts, has = ngrams(batch)
    n = sum(np.add.reduceat(g != BUCKETS, starts, dtype=np.int64) for g in grams)
    ll = sum(np.add.reduceat(matrix[g], starts, axis=0, dtype=np.float64) for g in grams)
    ll *= (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None]
    p = np.exp(ll - ll.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    score = np.where(has, p[np.arange(len(best)), best], 0.0)
    return [langs[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)], score


def held_out() -> F.Column:
    """Rows that training leaves out: crc32 of doc_id as text is 2 modulo 4 (a null doc_id: false)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, langs: list[str], matrix: np.ndarray, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with lang_out and score_out added (columns of those names are replaced).  Only the texts go to Python, and only the results come back."""
    model = docs.sparkSession.sparkContext.broadcast((langs, matrix))  # at most MAX_LANGUAGES x BUCKETS numbers

    def run(column: pa.Array) -> pa.Array:
        langs, matrix = model.value
        found, scores = [], []
        for _, _, data in text_chunks(column, _CHUNK):
            lang, score = predict([t.decode() for t in data], langs, matrix)
            found += lang
            scores.append(score)
        return pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=["lang", "score"])

    name = free_name(docs.columns, "__found")
    others = [c for c in docs.columns if c.lower() not in (lang_out.lower(), score_out.lower())]
    found = docs.withColumn(name, text_function(run, "lang string, score double")(F.col(text_col)))
    return found.select(*(F.col(quoted(c)) for c in others), F.col(f"{name}.lang").alias(lang_out), F.col(f"{name}.score").alias(score_out))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, matrix = train(docs.where(~held_out()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return identify(rows, langs, matrix).drop("text")


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2
