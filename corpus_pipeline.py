"""From raw documents to packed sequences: five stages, each one operator of tessel.llm over all that the one before kept.

run(spark, sf_dir) applies STAGES to the table documents; every stage's result is written as Parquet in the shared folder
and read again. All stages but the last return the columns of documents.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and further columns of any
name; columns that a stage needs for itself get names that no table has.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import cnn, jaccard, mixing, packing, pii
from tessel.llm.shared import remainder, table, written

#: Shares of all tokens in the mix. A corpus with less toxic text than this keeps its shares. Sound documents have rates of 1
#: or more, so none of them is lost.
TARGETS = {"sound": 0.96, "toxic": 0.04}


def _own(name: str) -> str:
    """A column name that no table has."""
    return f"_{name}_{uuid.uuid4().hex}"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network gives a score of 0.3 or more.

    A null text counts as empty; an empty one is scored as padding. Repeated rows get equal scores. Without labels of both
    kinds all texts get the share of good ones. An empty table stays empty.
    """
    p = cnn.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    score = _own("score")
    return cnn.scored(docs, p, docs.columns, name=score).filter(F.col(score) >= 0.3).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 5-word shingles, Jaccard similarity of 0.8 or more.

    Of a group the smallest id stays; rows that repeat it with the same text stay once. Rows without an id, or without a word,
    all stay. An id that also has another text keeps that row. An empty table stays empty.
    """
    return jaccard.deduplicated(docs, jaccard.Settings(words=5, percent=80))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts replaced by its kind; n_chars follows.

    Null and empty texts stay, with a null or 0 n_chars; all rows stay, repeated ones too. An empty table stays empty.
    """
    clean = pii.without(docs, pii.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says, rounded by the hash of its id.

    A null or empty text has no tokens; its rate follows from its posteriors like any other. Repeated rows get equal rates.
    Without labels, or without tokens, all rates are 1. An empty table stays empty.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "sound").alias("domain"))
    fitted, _ = mixing.fitted(docs, labels, TARGETS, whole="sound")
    mixed, copy = _own("mix"), _own("copy")
    times = mixing.copies(F.col(mixed)["rate"], F.col("doc_id"))
    return fitted.on(docs, name=mixed).withColumn(copy, F.explode(F.array_repeat(F.lit(1), times))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 2048 tokens.

    A null or empty text is one piece, the end token. Repeated rows are packed each. An empty table gives an empty result.
    """
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), ["doc_id"], known=150_000)  # the workers hold earlier stages' memory too


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("mixing to target weights", mix),
    ("best-fit packing", pack),
]

#: No stage but the last two's bookkeeping can be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
