"""What the operators of this package share: the shared folder, exact ranks and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasmill.functions import shared
from atlasmill.functions.shared import ranked, shared_folder, shuffle_parts, small, unstash

__all__ = ["SPACED_WORD", "fold", "let_go", "ranked", "shared_folder", "shuffle_parts", "small", "stash", "unstash"]

#: A word for the operators that split on white space only.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes that go to Python at once: texts may be long, and both sides hold a whole batch.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def stash(df: DataFrame, label: str) -> DataFrame:
    """A table of df in the shared folder, written with small batches for Python."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in BATCH}
    for k, v in BATCH.items():
        conf.set(k, str(min(v, int(before[k])) if before[k] and before[k].isdigit() and int(before[k]) > 0 else v))
    try:
        return shared.stash(df, label)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def let_go(spark: SparkSession) -> None:
    """Asks for a collection of garbage, so that shuffle files nobody refers to leave the disks early."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; null ids fall into fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds), F.lit(0).cast("long"))
