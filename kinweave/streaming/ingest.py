"""Streams of arriving rows: counts by event time, and upserts of entities batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def arrivals(stream: DataFrame, by: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window start, by, n): arrivals per window of ingested_at; rows later than the watermark are left out."""
    return (
        stream.withWatermark("ingested_at", late)
        .groupBy(F.window("ingested_at", width).alias("w"), by)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), by, "n")
    )


def upsert(stream: DataFrame, keys: list[str], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Hands each batch to the sink with one row a key, the latest by ingested_at; the sink gets the batch's
    number, so a batch that is replayed after a failure can be recognised."""

    def each(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        best = F.max(F.struct("ingested_at", *[c for c in rest if c != "ingested_at"])).alias("r")
        sink(batch.groupBy(*keys).agg(best).select(*keys, "r.*"), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("append").start()
