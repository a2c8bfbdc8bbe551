"""JSON Lines with physical line numbers, blank lines counted, and a status for every row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_rows(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Per non-blank line: source_file, source_line (from 1), value, parsed (variant), status.

    Files are read in blocks. A row's place in its block comes from the row counter of its task, and a
    prefix sum over one row per block gives what stands before it, so no file has to fit into one task.
    """
    lines = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.jsonl").text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    blocks = lines.groupBy("source_file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    parsed = F.try_parse_json("value")
    status = F.when(parsed.isNull(), "bad_json").when(~F.schema_of_variant(parsed).startswith("OBJECT"), "not_an_object").otherwise("ok")
    return (
        lines.join(blocks, ["source_file", "_block"])
        .where(F.trim("value") != "")
        .select("source_file", (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias("source_line"), "value", parsed.alias("parsed"), status.alias("status"))
    )


def required(rows: DataFrame) -> DataFrame:
    """rows of read_rows; the first bad one stops the job with its file and line."""
    where = F.concat("source_file", F.lit(":"), F.col("source_line").cast("string"), F.lit(" "), "status")
    return rows.withColumn("status", F.when(F.col("status") == "ok", F.col("status")).otherwise(F.raise_error(where)))


def placed(rows: DataFrame) -> DataFrame:
    """Adds domain (the folder) and split (the file's stem)."""
    parts = F.split("source_file", "/")
    return rows.withColumn("domain", F.element_at(parts, -2)).withColumn("split", F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", ""))
