"""Cleaning of a document corpus in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import jaccard, langid, packing, pii, substring
from rasterloom.llm.common import Scratch, free_name, quoted, released, table

MIN_LANGUAGE_SCORE = 0.5  # below, no language is likelier than all others together


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a recognised language; und (null or letterless) and undecided ones go."""
    langs, matrix = langid.train(docs.where(~langid.held_out()))
    lang, score = free_name(docs.columns, "__lang"), free_name(docs.columns, "__score")
    found = langid.identify(docs, langs, matrix, lang_out=lang, score_out=score)
    return found.where((F.col(lang) != "und") & (F.col(score) >= MIN_LANGUAGE_SCORE)).drop(lang, score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies (five-word shingles, Jaccard at least 0.8; SimHash BK-trees, then min-hash buckets, each link verified): that with the smallest doc_id."""
    return jaccard.representatives(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words in repeated windows out of the texts; documents that had words and have none left go."""
    return substring.cleaned(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; n_chars follows the text."""
    found = pii.find(docs, keep={c: c for c in docs.columns})
    text, changed = F.col("kept.text"), F.size("spans") > 0
    done = found.withColumn("clean", pii.redacted(text, F.col("spans")))
    made = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(changed, F.char_length("clean").cast("long")).otherwise(F.col("kept.n_chars"))
    return done.select(*(made.get(c, F.col(f"kept.{quoted(c)}")).alias(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the remaining documents' tokens into sequences (see op4)."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: Components of near copies, learned languages and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents.  Each stage's own scratch tables go when its result is written, and that when the next one's is."""
    scratch = Scratch(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with released():
            docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
