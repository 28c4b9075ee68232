"""Bounded samples of labelled documents, for operators that fit a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import in_fold, share


def labelled_sample(df: DataFrame, labels: DataFrame, label: str, sample: int, doc_id: str = "doc_id", text: str = "text", folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, text, y and part (0 to 99) of about ``sample`` labelled rows outside the held-out fold.

    The rows are chosen by a hash of their id, so always alike; ``sample`` bounds what is fitted on and
    what is broadcast to find the texts. Rows of one id count with their largest label, equal texts once.
    """
    own = labels.select(F.col("doc_id").alias("labelled"), F.col(label).cast("int").alias("y")).filter("labelled is not null and y is not null")
    own = own.filter(~in_fold("labelled", folds, held)).groupBy("labelled").agg(F.max("y").alias("y"))
    n = own.count()
    chosen = own.filter(share("labelled", label, sample, n))
    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))
    rows = rows.withColumn("same", F.xxhash64("text")).dropDuplicates(["same", "y"])
    return rows.select("doc_id", "text", "y", F.pmod(F.xxhash64(F.lit("part"), "same"), F.lit(100)).alias("part"))
