"""The pipeline's near copies against brute-force Jaccard similarity."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from rasterloom.llm import jaccard

SF = "/root/testdata/sf0.001"


def grams(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def kept(rows):
    """Smallest doc_id of each component of the pairs with a Jaccard similarity of 0.8 or more."""
    sets = {d: grams(t) for d, t in rows}
    left, out = sorted(sets), []
    while left:
        out.append(left[0])
        todo, left = [left[0]], left[1:]
        while todo:
            a = sets[todo.pop()]
            near = [d for d in left if a == sets[d] or 5 * len(a & sets[d]) >= 4 * len(a | sets[d]) > 0]
            todo += near
            left = [d for d in left if d not in near]
    return out


def families():
    """Copies with edits around the threshold, and a chain whose ends are far apart."""
    rng = random.Random(3)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts = [None, "", "one two", "One TWO", "a b c d e"]
    for _ in range(12):
        base = say(120)
        for edits in (1, 2, 2, 3, 3, 4, 8):
            copy = list(base)
            for at in rng.sample(range(120), edits):
                copy[at] = "edited"
            texts.append(" ".join(copy))
    chain = say(300)
    texts += [" ".join(chain[i * 12 : i * 12 + 150]) for i in range(10)]
    family = say(100)
    for _ in range(80):
        copy = list(family)
        for at in rng.sample(range(100), 2):
            copy[at] = f"v{rng.randrange(9999)}"
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("which", ["families", "table"])
def test_near_duplicates_by_jaccard(spark, which):
    rows = families() if which == "families" else [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, source string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    got = got.collect()
    assert sorted(r.doc_id for r in got) == kept(rows)
    assert all(dict(rows)[r.doc_id] == r.text for r in got)


def test_sketch_never_hides_a_link():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = rng.integers(0, 1 << 63, rng.integers(1, 400), dtype=np.uint64)
        b = np.concatenate((a[rng.integers(0, 1 + len(a) // 5) :], rng.integers(0, 1 << 63, rng.integers(0, 1 + len(a) // 5), dtype=np.uint64)))
        bits = np.array([jaccard.sketch(x) for x in (a, b)])
        if jaccard.similar(np.unique(a), np.unique(b)):
            assert jaccard.slack(bits, np.array([len(a), len(b)]), 0)[1] <= 1
