"""Tables of a data folder as DataFrames and SQL views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from atlasmill.functions.shared import small

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def run_sql(spark: SparkSession, folder: str, text: str, sent: tuple[str, ...] = ()) -> DataFrame:
    """Runs SQL over the folder's tables. Tables are passed as DataFrames where the text names them after FROM or JOIN,
    so no view is left behind and columns may be called like tables. Those in `sent` go to all tasks if they are small."""
    used: set[str] = set()

    def put(m: re.Match) -> str:
        used.add(m[2])
        return f"{m[1]} {{{m[2]}}}"

    text = re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(TABLES)})\b", put, text.replace("{", "{{").replace("}", "}}"))
    return spark.sql(text, **{n: small(table(spark, folder, n)) if n in sent else table(spark, folder, n) for n in used})
