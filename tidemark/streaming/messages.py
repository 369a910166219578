"""Structured Streaming: exact-once rows of message streams, a late branch, coalescing, and merges into tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def message_stream(spark, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(messages: DataFrame, delay: str = "60 minutes") -> DataFrame:
    """One row for each (source_id, external_id, digest of the text) seen within the watermark's delay."""
    hashed = messages.withColumn("content_hash", F.sha2("text", 256))
    return hashed.withWatermark("published_at", delay).dropDuplicatesWithinWatermark(["source_id", "external_id", "content_hash"])


def with_lateness(messages: DataFrame, ceiling_minutes: int = 60) -> DataFrame:
    """messages with late: those that took the ceiling or longer are archived, not published; none is dropped."""
    age = (F.unix_micros("received_at") - F.unix_micros("published_at")) / 6e7
    return messages.withColumn("late", age >= ceiling_minutes)


def coalesced(messages: DataFrame, keys: list[str], window_seconds: int = 120) -> DataFrame:
    """messages with kept: within the window after the last kept row of its key a row is not. The state of a key is that
    one instant; it goes when the watermark has passed the window."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in messages.schema.fields) + ", kept boolean"
    window = pd.Timedelta(seconds=window_seconds)

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        for rows in batches:
            rows = rows.sort_values("published_at", kind="stable")
            kept = []
            for at in rows["published_at"]:
                kept.append(last is None or at.value // 1000 - last >= window_seconds * 1_000_000)
                last = at.value // 1000 if kept[-1] else last
            yield rows.assign(kept=kept)
        state.update((last,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), last // 1000) + int(window.total_seconds() * 1000) + 1)

    return messages.withWatermark("published_at", "60 minutes").groupBy(*keys).applyInPandasWithState(step, schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def idempotent_append(target: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends the rows whose keys the table at `target` lacks, so a batch that runs twice adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(keys)
        path = batch.sparkSession._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(batch.sparkSession._jsc.hadoopConfiguration()).exists(path):
            new = new.join(batch.sparkSession.read.schema(batch.schema).parquet(target).select(*keys), keys, "left_anti")
        new.write.mode("append").parquet(target)

    return write


def run_available(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Everything that is there now, then stop: how a stream catches up after a pause."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
