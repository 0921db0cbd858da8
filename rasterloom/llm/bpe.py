"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a batch are laid out as one array of symbols.  An index
maps each pair of neighbouring symbols to all its positions; the active ranks
sit in a heap and are applied in ascending order, each at all its positions from
left to right, and the lists of the neighbouring pairs are updated.  The words'
ids are kept in a bounded cache of the worker.  Text is normalised and split as
the vocabulary file says.

Null texts count as empty: no ids, empty decoded text.  Every row gives a row,
repeated ones too; an empty table gives an empty result.  Very long texts are
encoded whole, one at a time.  Other columns are not read, or kept by encode().
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORKER_CACHES, byte_sizes, empty_caches, record_batch, slices, table, texts

CACHE_WORDS = 900_000  # distinct words that a worker remembers
_CHUNK = 2 << 20
_STOP, _GONE = 65_534, 65_535
_NO_RANK = 1 << 30
_SLOT_BITS = 17
_SHIFT = np.uint32(32 - _SLOT_BITS)
_MULTIPLIERS = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)  # odd numbers that spread the high bits
#: str.split() takes these for white space, the vocabulary does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Beyond these code points the library's own Unicode tables decide, as versions differ.
_RARE = re.compile("[^\u0000-\u02ff\u2010-\u2027\u2030-\u205e\u20ac]")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, the rest follow from U+0100 on."""
    stays = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, nxt = [], 256
    for b in range(256):
        if b in stays:
            out.append(chr(b))
        else:
            out.append(chr(nxt))
            nxt += 1
    return out


class PairIndexBpe:
    """Encoder and decoder for one vocabulary file (BPE with an end-of-word suffix)."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        if len(self.vocab) >= _STOP:
            raise ValueError("vocabularies of 65,534 tokens at most")
        self.parts = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in merges]  # by rank
        rank_of = {a << 16 | b: r for r, (a, b, _) in enumerate(self.parts)}
        self.ranked = rank_of.get
        self.pair_keys = np.array(sorted(rank_of), np.uint32)
        self.pair_ranks = np.array([rank_of[k] for k in self.pair_keys.tolist()], np.int32)
        self.place_pairs()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.space = regex.compile(r"\s+")
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        alphabet = byte_alphabet()
        self.first = [self.vocab[c] for c in alphabet]
        self.last = [self.vocab[c + self.suffix] for c in alphabet]
        self.byte_of = {c: b for b, c in enumerate(alphabet)}
        self.path, self.library = path, None
        self.cache: dict[str, bytes] = {}

    def lib(self):
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return self.library

    def split_words(self, text: str) -> list[str]:
        """The normalised words of a text without special tokens."""
        ascii = text.isascii()
        if ascii or not _RARE.search(text):
            word = text if ascii else unicodedata.normalize("NFC", text)
            low = word.lower()
            if low.isalpha():
                return [low]
            if low[:-1].isalpha() and low[-1] in ".,;:!?":
                return [low[:-1], low[-1]]
        else:
            lib = self.lib()
            words = lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(text))
            return [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in words]
        return self.words.findall(low)

    def merge_in_rounds(self, words: list[str]) -> None:
        """The same ids as merge_words, by numpy: each round applies each word's own lowest rank in all words at once."""
        first, last = np.array(self.first, np.uint32), np.array(self.last, np.uint32)
        data = "\n".join(words).encode() + b"\n"
        raw = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero(raw == 10)  # words hold no white space
        syms = first[raw]
        syms[ends - 1] = last[raw[ends - 1]]
        syms[ends] = _STOP
        owner = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(ends, prepend=-1))
        done_syms, done_owner = [], []
        ranks = self.ranks_at(syms[:-1], syms[1:])
        ranks = np.append(ranks, np.int32(_NO_RANK))
        news = np.array([p[2] for p in self.parts] + [0], np.uint32)
        while len(syms):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            best = np.minimum.reduceat(ranks, starts)
            sizes = np.diff(starts, append=len(owner))
            live = np.repeat(best < _NO_RANK, sizes)
            if not live.all():
                done_syms.append(syms[~live])
                done_owner.append(owner[~live])
                syms, owner, ranks = syms[live], owner[live], ranks[live]
                sizes, best = sizes[best < _NO_RANK], best[best < _NO_RANK]
                if not len(syms):
                    break
            at = np.flatnonzero(ranks == np.repeat(best, sizes))
            run = np.diff(at, prepend=-2) != 1  # of overlapping pairs (x x x) every other one counts, from the left
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
            syms[at] = news[ranks[at]]
            gone = np.ones(len(syms), bool)
            gone[at + 1] = False
            moved = at - np.arange(len(at))  # the merged symbols' places afterwards
            syms, owner, ranks = syms[gone], owner[gone], ranks[gone]
            ranks[moved] = self.ranks_at(syms[moved], syms[moved + 1])
            before = moved[moved > 0] - 1
            ranks[before] = self.ranks_at(syms[before], syms[before + 1])
        syms, owner = np.concatenate(done_syms), np.concatenate(done_owner)
        syms = syms[np.argsort(owner, kind="stable")]
        stops = (4 * np.flatnonzero(syms == _STOP)).tolist()
        out = syms.astype("<u4").tobytes()
        self.cache_words.update((w, out[s:e]) for w, s, e in zip(words, [0, *(x + 4 for x in stops)], stops, strict=False))

    def ranks_at(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a << np.uint32(16)) | b
        one, two = (keys * m >> _SHIFT for m in _MULTIPLIERS)
        other = self.slots[1]
        return np.where(self.slots[0][one] == keys, self.slot_ranks[0][one], np.where(other[two] == keys, self.slot_ranks[1][two], np.int32(_NO_RANK)))

    def place_pairs(self) -> None:
        """A table of two places for each pair, of which it takes one: pairs that find theirs taken push the one there to its other place."""
        places = [(self.pair_keys * m >> _SHIFT).tolist() for m in _MULTIPLIERS]
        held: list[dict[int, int]] = [{}, {}]
        for i in range(len(self.pair_keys)):
            side, pair = 0, i
            for _ in range(1000):
                at = places[side][pair]
                pair, held[side][at] = held[side].get(at, -1), pair
                if pair < 0:
                    break
                side = 1 - side
            else:
                raise ValueError("pairs do not fit their table")
        self.slots = [np.zeros(1 << _SLOT_BITS, np.uint32) for _ in range(2)]
        self.slot_ranks = [np.full(1 << _SLOT_BITS, _NO_RANK, np.int32) for _ in range(2)]
        for slots, ranks, own in zip(self.slots, self.slot_ranks, held, strict=True):
            at = np.array(list(own), np.int64)
            pairs = np.array(list(own.values()), np.int64)
            slots[at], ranks[at] = self.pair_keys[pairs], self.pair_ranks[pairs]

    def merge_words(self, words: list[str]) -> None:
        """Encode distinct words together and put their ids into the cache."""
        first, last = self.first, self.last
        laid: list[int] = [_STOP]  # a stop stands before, between and after the words; it pairs with nothing
        for text in words:
            data = text.encode()
            laid += [first[b] for b in data[:-1]]
            laid.append(last[data[-1]])
            laid.append(_STOP)
        n = len(laid)
        start = np.array(laid, np.int64)
        keys = ((start[:-1] << 16) | start[1:]).astype(np.uint32)
        where = np.searchsorted(self.pair_keys, keys).clip(max=len(self.pair_keys) - 1)
        hits = np.flatnonzero(self.pair_keys[where] == keys)
        ranks = self.pair_ranks[where[hits]]
        order = np.argsort(ranks, kind="stable")
        active, cuts = np.unique(ranks[order], return_index=True)
        index: dict[int, list[int]] = {r: p.tolist() for r, p in zip(active.tolist(), np.split(hits[order], cuts[1:]), strict=True)}
        heap = active.tolist()  # ascending, so a heap
        syms, left, right = laid, list(range(-1, n - 1)), list(range(1, n + 1))
        parts, ranked, find, push, pop = self.parts, self.ranked, index.get, heapq.heappush, heapq.heappop
        while heap:
            rank = pop(heap)
            a, b, new = parts[rank]
            high = new << 16
            found = index.pop(rank)
            if len(found) > 1:
                found.sort()
            for i in found:
                j = right[i]
                if syms[i] != a or syms[j] != b:
                    continue  # an earlier merge took one of them
                syms[i], syms[j] = new, _GONE
                k, h = right[j], left[i]
                right[i], left[k] = k, i
                if (r := ranked(high | syms[k])) is not None:
                    if (p := find(r)) is None:
                        index[r] = [i]
                        push(heap, r)
                    else:
                        p.append(i)
                if (r := ranked(syms[h] << 16 | new)) is not None:
                    if (p := find(r)) is None:
                        index[r] = [h]
                        push(heap, r)
                    else:
                        p.append(h)
        done = np.array(syms, np.int64)
        done = done[done != _GONE]
        stops = np.flatnonzero(done == _STOP).tolist()
        data = done.astype("<u4").tobytes()
        self.cache_words.update((w, data[4 * s + 4 : 4 * e]) for w, s, e in zip(words, stops, stops[1:]))

    def learn(self, tokens: list[str], in_rounds: bool) -> None:
        """Put the ids of new white-space separated pieces of text into the cache."""
        low = [t.lower() if t.isascii() else "" for t in tokens]
        plain = [w.isalpha() for w in low]  # pieces that are one word
        rest = [t for t, one in zip(tokens, plain, strict=True) if not one]
        split = list(map(self.split_words, rest))
        words = set(compress(low, plain)).union(*split)
        self.cache_words: dict[str, bytes] = {}
        (self.merge_in_rounds if in_rounds else self.merge_words)(list(words))
        get = self.cache_words.__getitem__
        self.cache.update(zip(compress(tokens, plain), map(get, compress(low, plain)), strict=True))
        self.cache.update(zip(rest, [b"".join(map(get, w)) for w in split], strict=True))

    def forget(self) -> None:
        """Empty the cache of words."""
        if self.cache:
            self.cache = {}

    def encode_batch(self, batch: list[str], in_rounds: bool = False) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        cut: list[list] = []
        for text in batch:
            pieces = self.at_special.split(text) if self.at_special and "<|" in text else [text]
            cut.append([p if k % 2 else (self.space.split(p) if _SEPARATORS.search(p) else p.split()) for k, p in enumerate(pieces)])
        new = list(set().union(*(p for pieces in cut for p in pieces[::2])).difference(self.cache))
        if new:
            self.learn(new, in_rounds)
        get = self.cache.__getitem__
        return [b"".join(self.special[p].to_bytes(4, "little") if k % 2 else b"".join(map(get, p)) for k, p in enumerate(pieces)) for pieces in cut]

    def decode(self, ids: bytes) -> str:
        """Text of ids, special tokens included: the file names no decoder, so tokens are joined by spaces; unknown ids give nothing."""
        a = array("I")
        a.frombytes(ids)
        if sys.byteorder == "big":
            a.byteswap()
        try:
            return " ".join(map(self.tokens.__getitem__, a))
        except KeyError:
            return " ".join(self.tokens[i] for i in a if i in self.tokens)


@lru_cache(maxsize=2)
def encoder(path: str) -> PairIndexBpe:
    made = PairIndexBpe(path)
    WORKER_CACHES["words"] = made.forget
    return made


def chunked(column: pa.Array, limit: int = _CHUNK) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of a column by chunks of about limit bytes."""
    empty_caches("words")
    for i, j in slices(byte_sizes(column).tolist(), limit):
        yield i, texts(column.slice(i, j - i))


def encode_decode(df: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text of each row."""
    path = path or vocabulary_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        sha = hashlib.sha256
        for b in batches:
            for at, part in chunked(b.column(1)):
                ids = bpe.encode_batch(part)
                yield record_batch({"doc_id": b.column(0).slice(at, len(part)), "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [sha(x).hexdigest() for x in ids], "decoded_sha256": [sha(bpe.decode(x).encode()).hexdigest() for x in ids]}, schema)

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(df: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """The rows with a column token_ids array<int> added (replacing one of that name)."""
    path = path or vocabulary_path()

    def ids(col):
        import numpy as np
        import pandas as pd

        return pd.Series([np.frombuffer(x, "<u4").astype("i4") for x in encoder(path).encode_batch([t or "" for t in col])])

    return df.withColumn("token_ids", F.pandas_udf(ids, "array<int>")(F.col(text_col)))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
