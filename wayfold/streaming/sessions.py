"""Structured Streaming forms of the per-key state: session windows with a watermark, and taste learning in order."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wayfold.operators.lineage import checkpoint_dir

LIMIT = 5.0


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; event time is a TIMESTAMP, as watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a pattern, as a stream's plain path has to be a folder and the table may be one file
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def session_counts(events: DataFrame, key: str, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Events per session of a key; a session closes when the watermark passes its end."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap), key)
        .agg(F.count("*").alias("events"))
        .select(key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ends"), "events")
    )


def learn_taste(events: DataFrame, key: str, order: list[str], step: str) -> DataFrame:
    """After every micro-batch each key's taste: its steps added in order, clamped to 5 either way and rounded to 2 decimals each time."""

    def update(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        taste, n = state.get if state.exists else (0.0, 0)
        rows = [b for b in batches if len(b)]
        for row in pd.concat(rows).sort_values(order).itertuples(index=False):
            taste = round(max(-LIMIT, min(LIMIT, taste + getattr(row, step))), 2)
            n += 1
        state.update((taste, n))
        yield pd.DataFrame({key: [name[0]], "taste": [taste], "events": [n]})

    shape = "taste double, events long"
    return events.groupBy(key).applyInPandasWithState(update, f"{key} long, {shape}", shape, "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns its output, written as Parquet below the checkpoint folder."""
    path = f"{checkpoint_dir(stream.sparkSession)}/streams/{uuid.uuid4().hex}"

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("append").parquet(f"{path}/out")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(save).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = stream.withColumn("batch", F.lit(0).cast("long")).schema
    return stream.sparkSession.read.schema(schema).parquet(f"{path}/out")
