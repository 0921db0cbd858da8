"""The pipeline's stages against plain versions."""

import pyarrow.parquet as pq
import pytest

import corpus_pipeline

from . import brute
from .test_jaccard import kept
from .test_rest import check_packing

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {"": pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = [r.asDict() for r in docs.collect()]
        if name != "packing":
            assert docs.columns == COLUMNS
    return out


def test_language_keeps_clean(stages):
    assert len(stages["language"]) >= 0.99 * len(stages[""])


def test_near_duplicates(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages["language"]]
    assert sorted(r["doc_id"] for r in stages["near_duplicates"]) == kept(rows)
    text = dict(rows)
    assert all(text[r["doc_id"]] == r["text"] for r in stages["near_duplicates"])


def test_substrings(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages["near_duplicates"]]
    before = {r["doc_id"]: r for r in stages["near_duplicates"]}
    after = {r["doc_id"]: r for r in stages["substrings"]}
    for doc, n, removed, digest in brute.op2(rows):
        if removed and removed == n:
            assert doc not in after
            continue
        words = brute.WORD.findall(after[doc]["text"])
        assert brute.sha(" ".join(words)) == digest
        assert after[doc]["n_chars"] == (len(after[doc]["text"]) if removed else before[doc]["n_chars"])
        if not removed:
            assert after[doc]["text"] == before[doc]["text"]


def test_personal_data(stages):
    before = {r["doc_id"]: r["text"] for r in stages["substrings"]}
    for r in stages["personal_data"]:
        spans, at, out = brute.op3_spans(before[r["doc_id"]]), 0, []
        for s, _, kind, e in spans:
            if s >= at:
                out += [before[r["doc_id"]][at:s], f"[{kind.upper()}]"]
            at = max(at, e)
        assert r["text"] == "".join(out) + before[r["doc_id"]][at:]
        assert not brute.op3_spans(r["text"]) or any(k == "card" for _, _, k, _ in brute.op3_spans(r["text"]))


def test_packing(stages):
    from tokenizers import Tokenizer

    from rasterloom.llm.bpe import vocabulary_path

    lib = Tokenizer.from_file(vocabulary_path())
    lib.no_truncation()
    check_packing(stages["packing"], {r["doc_id"]: len(lib.encode(r["text"], add_special_tokens=False).ids) + 1 for r in stages["personal_data"]})


def test_stages_take_odd_rows(spark):
    odd = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "s", 0), (2, "word " * 5000, "en", "s", 1), (2, "word " * 5000, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SF).collect()
            if rows is odd:
                assert {"language": len(out) == 2, "near_duplicates": len(out) == 2, "substrings": len(out) == 3, "personal_data": len(out) == 5, "packing": len(out) >= 5}[name], (name, len(out))


def test_run_like_its_stages(spark, stages):
    """run() gives the rows of the last stage and leaves only that stage's table."""
    from rasterloom.llm.common import Folder

    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    out = corpus_pipeline.run(spark, SF)
    rows = [r.asDict() for r in out.collect()]
    assert sorted(map(key, rows)) == sorted(map(key, stages["packing"]))
    folder = out.inputFiles()[0].rsplit("/", 2)[0]
    assert Folder(spark, folder).names() == ["packing"]


def test_stages_keep_clashing_columns(spark):
    names = ["__mark", "__row", "__key", "__starts", "__new", "__lang", "__score", "__found", "kept", "base", "spans", "clean", "lang_pred", "score", "set", "fp", "x`y", "a.b"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    from pyspark.sql import functions as F

    docs = docs.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert {tuple(r)[5:] for r in out.collect()} == {tuple(range(len(names)))}, name
    assert corpus_pipeline.packed(spark, docs, SF).count() >= 60


def test_scratch_needs_a_shared_folder(spark):
    from rasterloom.llm import common

    class Cluster:
        class sparkContext:
            master, applicationId = "spark://host:7077", "a"

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(ValueError):
        common.scratch_root(Cluster)
    Cluster.conf.get = staticmethod(lambda name, default=None: "hdfs://shared/")
    assert common.scratch_root(Cluster).startswith("hdfs://shared/rasterloom/")
    with common.released():
        one = common.Scratch(spark)
        one.write(spark.range(3), "t")
        assert one.names() == ["t"]
    assert one.names() == []
