"""Streams over the events table: watermarked windows and keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 4) -> DataFrame:
    """A folder of Parquet files as a stream with event time."""
    made = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return made.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_prices(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and type; rows later than the watermark are dropped by the state store."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    made = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return made.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


def last_snapshots(events: DataFrame) -> DataFrame:
    """Per user the newest event seen so far, as an update stream of keyed state (latest ts, then event_id)."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        for pdf in batches:
            row = pdf.sort_values(["ts", "event_id"]).iloc[-1]
            now = (int(row.ts.value), int(row.event_id), float(row.value))
            best = now if best is None or now[:2] > tuple(best)[:2] else best
        state.update(tuple(best))
        yield pd.DataFrame({"user_id": [key[0]], "event_id": [best[1]], "price": [best[2]]})

    own = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    return own.groupBy("user_id").applyInPandasWithState(update, "user_id long, event_id long, price double", "ts long, event_id long, price double", "update", GroupStateTimeout.NoTimeout)


def append_snapshots(stream: DataFrame, path: str, checkpoint: str):
    """Appends a stream's rows as Parquet once over what is there; the checkpoint makes a restart exact."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
