"""Operators 1, 2, 5 and 8 against plain versions."""

import random

import pyarrow.parquet as pq
import pytest

from rasterloom.llm import bpe, fingerprint, simhash, substring

from . import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, fp long, h string, n long, key string"


def odd_rows():
    rng = random.Random(5)
    vocab = ["alpha", "beta", "Gamma", "dé", "x", "日本"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = say(80)
    texts = [None, "", " \t\n", "one", "a b c", "a b c d", "A B C D", passage, passage, "pre " + passage + " post", "x " * 300, say(36) + "\n" + say(3000), passage.replace(" ", "\n\n") + " end", say(34), say(35), "tab\tsplit\x0bword\x0c nbsp stays \x1c kept"]
    texts += [say(60) for _ in range(20)] + [passage] * 30 + ["word " * 20000, "y" * 50000, "!!"]
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 7, "h", 3, "k") for d, t in rows], SCHEMA).repartition(3)


def all_rows():
    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]


@pytest.fixture(params=["odd", "table"])
def rows(request):
    return odd_rows() if request.param == "odd" else all_rows()


def test_fingerprints(spark, rows):
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(frame(spark, rows)).collect()}
    assert {d: (r.n_chars, r.edited_sha256) for d, r in got.items()} == brute.op1(rows)
    text = dict(rows)
    for d, r in got.items():
        assert r.fingerprint == fingerprint.fingerprint_of(text[d] or "")
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    plain = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(frame(spark, rows)).collect()}
    assert plain == {d: r.fingerprint for d, r in got.items()}
    if len(rows) > 100:
        assert sum(r.near_edited > r.near_next for r in got.values()) > 0.95 * len(got)
        assert len({r.fingerprint for r in got.values()}) == len(set(text.values()))


def test_fingerprint_is_homomorphic():
    a = fingerprint.fingerprint_of("one\ntwo\nthree")
    assert a == fingerprint.fingerprint_of("three\none\ntwo") != fingerprint.fingerprint_of("three\none\ntwo\n")
    assert fingerprint.add(a, inserted=["four"], deleted=["two"]) == fingerprint.fingerprint_of("four\none\nthree")


def test_likeness_of_long_repetitive_texts():
    for n, char in ((40_000, "y"), (60_000, "y"), (90_000, "ab ")):
        text = char * (n // len(char))
        edited = text[: len(text) - len(text) // 3] + "something else " * 900
        x, y = fingerprint.paragraph_sums([text.encode(), edited.encode()])
        assert fingerprint.likeness(x[None], y[None])[0] > 0.9


def test_likeness_like_exact_counts():
    """The lanes' cosine against that of the exact counts of the windows."""
    from collections import Counter

    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "x", "yy"]) for _ in range(n))
    for share in (0.0, 0.3, 0.6, 0.9):
        a, b = say(900), say(900)
        b = a[: int(len(a) * share)] + "\n" + b[int(len(a) * share) :]
        a = a[: int(len(a) * share)] + "\n" + a[int(len(a) * share) :]
        count = lambda t: Counter(p[i : i + 16].ljust(16, "\0") for p in t.split("\n") for i in range(len(p)))
        x, y = count(a), count(b)
        cos = sum(n * y[w] for w, n in x.items()) / (sum(n * n for n in x.values()) * sum(n * n for n in y.values())) ** 0.5
        lanes = fingerprint.paragraph_sums([a.encode(), b.encode()])
        assert abs(fingerprint.likeness(lanes[:1], lanes[1:])[0] - cos) < 0.25


def test_fingerprints_of_hot_ids(spark):
    """Ids that most rows share and null ids are dealt over several ranges; each row's next is the same as in one sorted list."""
    import hashlib

    rows = [(7, f"seven {i}") for i in range(200)] + [(None, f"none {i}") for i in range(200)] + [(i, f"other {i}") for i in range(100, 160)] + [(7, "seven 1"), (3, None)]
    docs = spark.createDataFrame([(d, t, "x", 1, True) for d, t in rows], "doc_id long, text string, `order` string, `range` int, copy boolean").repartition(3)
    order = docs.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()
    order.sort(key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))
    want = []
    for r, nxt in zip(order, order[1:] + order[:1]):
        text, n = r.text or "", len(r.text or "") // 3
        want.append((r.doc_id, hashlib.sha256((text[: len(text) - n] + (nxt.text or "")[:n]).encode()).hexdigest()))
    got = [(r.doc_id, r.edited_sha256) for r in fingerprint.edited_fingerprints(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_fingerprints_ties_and_empty(spark):
    same = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, None), (2, "c")], "doc_id long, text string")
    assert fingerprint.edited_fingerprints(same).count() == 5
    assert fingerprint.edited_fingerprints(same.where("doc_id = 2")).count() == 1
    assert fingerprint.edited_fingerprints(same.limit(0)).count() == 0


def test_substrings(spark, rows):
    got = sorted(map(tuple, substring.removals(frame(spark, rows)).collect()), key=str)
    assert got == brute.op2(rows)


def test_substring_index_compacts(spark):
    from rasterloom.llm.common import Scratch

    index = substring.SubstringIndex(Scratch(spark), window=6, gram=3, fanout=2)
    texts = ["a b c d e f g h", "q r s t u v w", "a b c d e f g h", "z y x w v u t"]
    for t in texts:
        index.append(spark.createDataFrame([(t,)], "text string"))
    assert len(index.runs) == 1 and index.runs[0][0] == 2
    total = index.runs[0][2].where("n > 1").count()
    assert total == index.repeated().count() > 0


def test_substring_path_compacts(spark, monkeypatch):
    compacted = []
    old = substring.SubstringIndex._write
    monkeypatch.setattr(substring.SubstringIndex, "_write", lambda self, counts, level, first, last: (compacted.append(level), old(self, counts, level, first, last))[1])
    rows = odd_rows()
    assert sorted(map(tuple, substring.removals(frame(spark, rows)).collect()), key=str) == brute.op2(rows)
    assert compacted == [0, 0, 1, 0]


def test_substring_index_stays(spark, tmp_path):
    """Three calls on one folder: each finds what its documents repeat of all earlier ones."""
    from rasterloom.llm.common import Folder

    rows = odd_rows()
    parts = [rows[0::3], rows[1::3], rows[2::3]]
    for k, part in enumerate(parts):
        index = substring.SubstringIndex(Folder(spark, f"file://{tmp_path}/index"))
        assert index.history == k
        got = {r.doc_id: tuple(r) for r in substring.removals(frame(spark, part), index=index).collect()}
        upto = {x[0]: x for x in brute.op2([x for p in parts[: k + 1] for x in p])}
        assert got == {d: upto[d] for d, _ in part}
    left = Folder(spark, f"file://{tmp_path}/index").names()
    assert left == ["run-0-3-3", "run-1-1-2", "texts-1", "texts-2", "texts-3"]
    Folder(spark, f"file://{tmp_path}/index").write(spark.range(1).selectExpr("id h", "id n"), "run-0-1-1")  # as if a driver was lost between a compaction and its clean-up
    again = substring.SubstringIndex(Folder(spark, f"file://{tmp_path}/index"))
    assert again.history == 3 and [x[1] for x in again.runs] == ["run-1-1-2", "run-0-3-3"]


def test_gram_hashes_in_pieces(monkeypatch):
    data = b" ".join(b"word%d" % (i * i % 97) for i in range(5000)) + b" " + b"z" * 9000 + b" tail" * 40
    starts, ends = substring.word_bounds(data)
    whole = substring.gram_hashes(data, starts, ends, 12)
    monkeypatch.setattr(substring, "_PIECE", 700)
    assert (substring.gram_hashes(data, starts, ends, 12) == whole).all()


def test_substrings_empty(spark):
    assert substring.removals(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_simhash(spark, rows):
    got = {r.doc_id: (f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute.op5(rows)


def test_bk_tree_finds_all():
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    values = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 20, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for b in base]))
    tree = simhash.BkTree(values)
    got = {(int(a), int(b)) for q, n in tree.within(values, 4) for a, b in zip(q, n)}
    want = {(i, j) for i in range(len(values)) for j in range(len(values)) if (int(values[i]) ^ int(values[j])).bit_count() <= 4}
    assert got == want


def test_near_links_by_finer_shards(spark):
    """Shards above `large` are dealt anew, without losing a link; nearest() gives links only."""
    import numpy as np

    from rasterloom.llm.common import Scratch

    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    flips = lambda n: np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (400, n)).astype(np.uint64), axis=1)
    values = np.unique(np.concatenate([b ^ flips(n) for b in base for n in (1, 3, 7)]))
    fps = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long").repartition(3)

    def sets(edges):
        root = {int(v): int(v) for v in values.view(np.int64)}
        find = lambda x: x if root[x] == x else find(root[x])
        for a, b in edges:
            root[find(a)] = find(b)
        return {frozenset(x for x in root if find(x) == r) for r in root if root[r] == r}

    pairs = {(int(a), int(b)) for a, x in zip(values.view(np.int64), values) for b, y in zip(values.view(np.int64), values) if a < b and (int(x) ^ int(y)).bit_count() <= 4}
    got = [tuple(r) for r in simhash.links(fps, Scratch(spark), large=50).collect()]
    assert sets(got) == sets(pairs) == sets([tuple(r) for r in simhash.links(fps, Scratch(spark)).collect()])
    some = {tuple(sorted(r)) for r in simhash.links(fps, Scratch(spark), join=simhash.nearest, large=50).collect()}
    later = lambda edges: {max(p, key=lambda x: x % (1 << 64)) for p in edges}
    assert some <= pairs and later(some) == later(pairs)


def test_simhash_empty_and_odd(spark):
    got = simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert got.count() == 0
    rows = [(None, "a b c d e"), (None, "a b c d e"), (7, "A b c d e"), (3, None), (3, None), (9, "")]
    got = sorted(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    assert [(r.doc_id, r.component_id) for r in got] == [(3, 3), (3, 3), (7, 7), (9, 3), (None, 7), (None, 7)]


def test_components(spark):
    from rasterloom.llm.common import Scratch
    from rasterloom.llm.components import components

    edges = [(1, 2), (2, 1), (2, 3), (9, 9), (None, 4), (5, 6)] + [(100, 100 + i) for i in range(1, 300)] + [(500 + i, 501 + i) for i in range(40)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5} | {100 + i: 100 for i in range(300)} | {500 + i: 500 for i in range(41)}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_bpe_like_library(spark, rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.vocabulary_path())
    lib.no_truncation()
    rows = rows + [(9000 + i, t) for i, t in enumerate(["<|endoftext|>a <|startoftext|>", "İstanbul ΣΑΣ don't WE'LL 10²½", "日本語 🙂 \x85x\x1fy", "aaaa aaaaa", "naïve é"])]
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_decode(frame(spark, rows)).collect()}
    import hashlib

    import numpy as np

    for d, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[d] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(lib.decode(ids, skip_special_tokens=False))), t
    both = bpe.PairIndexBpe(bpe.vocabulary_path()), bpe.PairIndexBpe(bpe.vocabulary_path())
    texts = [t or "" for _, t in rows]
    assert both[0].encode_batch(texts) == both[1].encode_batch(texts, in_rounds=True)
    assert bpe.encode(frame(spark, rows[:5]).withColumn("token_ids", bpe.F.lit(1))).count() == 5


def test_bpe_empty_table(spark):
    assert bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string, token_ids string")).count() == 0
