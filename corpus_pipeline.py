"""The corpus pipeline: STAGES over documents, each written to the shared folder and read again.

Each stage works on all rows that the one before it kept, and all but the last return
the columns of documents as they are, whatever other columns there are.

Defined results: a null text, or one without a letter, is rejected by the language
stage; of the rows of one id, each is judged by its own text, and all of those that bear
the smallest id of a near-duplicate class stay; a row without an id is in no class and
stays; a null text that reaches the suffix stage stays null, and is packed as an end token.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mcqlab.llm import language_id, order_minhash, packing, quality, suffix_dedup
from mcqlab.llm.common import discard, stored, table


def _numbered(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with columns c0, c1, ..., so that none clashes with a result, and the new names of id and text."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names["doc_id"], names["text"]


def _named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs under their own names."""
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on the rated ones, selects."""
    model = quality.fitted(docs, table(spark, sf_dir, "labels"))
    own, _, text = _numbered(docs)
    return _named(quality.graded(own, model, text).where("selected"), docs)


def select_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with calibrated confidence."""
    model = language_id.fitted(docs)
    own, _, text = _numbered(docs)
    return _named(language_id.predicted(own, model, text).where("NOT rejected"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near-duplicates."""
    own, key, text = _numbered(docs)
    return _named(order_minhash.representatives(own, text, key), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the text that repeated strings of 200 bytes cover; n_chars, if there is one, counts anew."""
    own, key, text = _numbered(docs)
    out = suffix_dedup.deduplicated(own, text, key, keep=tuple(own.columns), with_text=True)
    out = out.withColumn(text, F.col("kept_text"))
    if "n_chars" in docs.columns:
        n_chars = f"c{docs.columns.index('n_chars')}"
        out = out.withColumn(n_chars, F.length("kept_text").cast(docs.schema["n_chars"].dataType))
    return _named(out, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of tokens, with their ids."""
    return packing.packed(docs, with_ids=True, known=150_000)  # workers are shared with the stages before


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", select_quality),
    ("language_id", select_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("packing", pack),
]
#: Trained models and packing have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        new = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            new = stored(new)
            discard(docs)
        docs = new
    return docs
