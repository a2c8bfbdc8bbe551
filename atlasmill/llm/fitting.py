"""What the classifiers share: a bounded labelled sample outside the held-out fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasmill.llm.common import fold


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """At most `most` rows (text, y) of the folds 1 to 4, the first by a hash of the id.

    A document with several labels counts as 1 if half of them are; null labels and ids are left out.
    The ids are at most `most`, so they are broadcast.
    """
    ids = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (fold(F.col(key)) != 0))
    ids = ids.groupBy(F.col(key).alias("_id")).agg((F.avg(F.col(label)) >= 0.5).cast("int").alias("y"))
    ids = ids.orderBy(F.xxhash64("_id"), "_id").limit(most)
    found = docs.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(ids), "_id")
    return found.select("_id", "text", "y")


def prior(ys: list[int]) -> float:
    return (sum(ys) + 1) / (len(ys) + 2)
