"""Corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the
next stage's documents. Filtering stages return the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandlake.llm.common import Scratch
from strandlake.llm.decontaminate import without_contaminated
from strandlake.llm.near_dup import without_near_duplicates
from strandlake.llm.packing import pack
from strandlake.llm.quality import resampled
from strandlake.llm.toxicity import without_toxic

#: SQL cannot express the trained stages; tests compare the stages with brute force.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not predict toxic.

    Each row is decided by its own text: null and repeated doc_ids are rows like any other, repeated rows are decided
    alike. A null or empty text has the classifier's constant as its score. Scores of exactly 0.3 are toxic. An empty
    table gives an empty one; without labels of both classes nothing or, if all are toxic, everything is rejected. Extra
    columns, whatever their names, stay.
    """
    return without_toxic(spark, docs, _table(spark, sf_dir, "labels"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling towards labelled good text, as many as are expected to be like it.

    Each row has the weight of its own text; a null or empty text has weight 0. Rows alike in doc_id and text go
    together; ties go to the smaller doc_id, null last. An empty table gives an empty one; without labelled good rows
    all rows stay. Extra columns, whatever their names, stay.
    """
    return resampled(spark, docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component (five-word shingles, Jaccard 0.8 and more): the smallest doc_id.

    Every row is a document: rows that share a doc_id, or have none, are compared by their texts. Rows with a null,
    empty or blank text all stay. An empty table gives an empty one. Extra columns, whatever their names, stay.
    """
    return without_near_duplicates(spark, docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage (weighted similarity of an item-sized window of 0.8 and more).

    Each row is decided by its own text; null and empty texts stay, and an empty benchmark rejects nothing. An empty
    table gives an empty one. Extra columns, whatever their names, stay.
    """
    return without_contaminated(spark, docs, _table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 4096 tokens.

    Every row is packed: null and repeated doc_ids come out as they are, a null or empty text is its end id alone. An
    empty table gives no rows; other columns are left out.
    """
    return pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", keep_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        after = scratch.table(stage(spark, docs, sf_dir), name)
        scratch.drop(docs)
        docs = after
    return docs
