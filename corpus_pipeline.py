"""A corpus pipeline of five stages: toxicity filter, near-duplicate removal, surrogates for personal data, source mixing, packing.

Each stage works on everything its predecessor kept. All but the last return the columns of `documents`; the last returns the pieces
of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.llm.common import read, written
from lettermill.llm.mixing import mixed_documents
from lettermill.llm.ngram_join import one_of_each
from lettermill.llm.packing import pack
from lettermill.llm.surrogate import QUERY_KEY, with_surrogates
from lettermill.llm.toxicity import fit, fold, without_toxic
from lettermill.shipping import ship


#: Words in a block of the mix: about a document, so that what shards take of one stays in few pieces.
MIX_BLOCK = 512


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the labels of folds 0 and 2.

    Documents without text stay, repeated rows stay or go alike, without labels all stay; an empty table gives no rows, other columns pass through.
    """
    ship(spark)
    return without_toxic(docs, fit(docs, read(spark, sf_dir, "labels"), usable=fold(F.col("doc_id")) != 1))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: the one with the smallest doc_id.

    Of repeated rows one stays. Documents without words and rows without doc_id are in no group and stay; an empty table gives no rows, other
    columns pass through.
    """
    ship(spark)
    return one_of_each(docs)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts becomes surrogates; all rows stay.

    Null and empty texts stay as they are, repeated rows change alike; an empty table gives no rows, other columns pass through.
    """
    ship(spark)
    return with_surrogates(docs, QUERY_KEY)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights: documents are repeated, cut or left out.

    Null sources form one source, documents without words go, repeated rows are documents of their own; an empty table gives no rows, other
    columns pass through.
    """
    ship(spark)
    return mixed_documents(docs, block=MIX_BLOCK)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed texts become sequences of tokens, as pieces of documents.

    A null text is its end token alone, repeated rows and null ids are documents of their own; an empty table gives no rows, other columns are
    ignored.
    """
    ship(spark)
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("surrogates", surrogates),
    ("mixing", mixing),
    ("packing", packing),
]

#: No SQL states a fitted toxicity model, keyed surrogates or retrieval packing; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of `documents`."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
