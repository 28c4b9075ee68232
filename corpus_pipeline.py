"""A training-corpus pipeline: language, toxicity, exact and near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the
last return the columns of their input, whatever their names; the last returns the packed pieces. A null
or empty text, a repeated row, a tie and an empty table are treated as each stage's operator says.
"""

from __future__ import annotations

import public_tokenizers as P
from pyspark.sql import DataFrame, SparkSession

from basalt.llm.common import documents, shared_folder
from basalt.llm.exact import exact_distinct
from basalt.llm.language import languages_known
from basalt.llm.packing import pack, packed_digest
from basalt.llm.simhash import near_distinct
from basalt.llm.toxicity import clean


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is told; texts that are null or have no letter go, and repeated rows stay.

    Learned from the rows given. An empty table, or one where no row says its language, gives no rows.
    """
    return languages_known(docs, P.path("byte_bpe_multi_50k.tiktoken"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows below the toxicity threshold; the labels are those of sf_dir.

    Null and empty texts score as texts without words; repeated rows stay or go together; a null doc_id is
    only not learned from. Without labels of both kinds all rows stay; an empty table gives none.
    """
    return clean(docs, documents(spark, sf_dir, "labels"))


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the longest, then the smallest doc_id, then the first of repeated rows.

    Null texts equal empty ones; null doc_ids come last. An empty table gives no rows.
    """
    return exact_distinct(docs)


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the smallest doc_id, then the first of repeated rows.

    Null and empty texts are one group; null doc_ids come last. An empty table gives no rows.
    """
    return near_distinct(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, packed into sequences; a null text is its end id alone, repeated rows are packed each.

    An empty table gives no rows.
    """
    return packed_digest(pack(docs, P.path("word_bpe_49k.json")))


STAGES = [
    ("language_id", known_language),
    ("toxicity", not_toxic),
    ("exact_dedup", one_of_equal),
    ("simhash", one_of_near),
    ("packing", packed),
]

#: SQL can't express the stages with models; they are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the documents of ``sf_dir``; each stage's rows are written as Parquet to the shared folder and read by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
