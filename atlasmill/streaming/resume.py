"""Incremental processing that resumes: a stream appended to a keyed table, each key once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from atlasmill.operators.sinks import insert_missing


def resume(stream: DataFrame, target: str, key: str, checkpoint: str) -> StreamingQuery:
    """Handles what is there since the last run and stops. A batch that ran before a crash adds nothing twice."""
    write = lambda batch, _: insert_missing(batch, target, key)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts per kind and tumbling window; rows later than `late` are dropped by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", kind, "n")
