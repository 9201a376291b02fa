"""Streams: review events to current state, and counts by event time. Beyond batch, same columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

EVENT = "event_id bigint, ts timestamp, analysis_id bigint, status string, expected_version bigint"


def read(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def status_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by status in windows of event time; windows close once the watermark passes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "status", "n")


def accept(events: DataFrame) -> DataFrame:
    """Optimistic concurrency on a stream: state is one count for each analysis."""
    ship(events.sparkSession)
    from pyspark.sql.streaming.state import GroupStateTimeout

    def fold(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        done = state.get[0] if state.exists else 0
        for rows in frames:
            out = []
            for e in rows.sort_values(["ts", "event_id"]).itertuples():
                ok = pd.isna(e.expected_version) or int(e.expected_version) == done
                done += ok
                out.append((key[0], e.event_id, done if ok else None, ok))
            yield pd.DataFrame({k: pd.array(v, t) for (k, t), v in zip((("analysis_id", "int64"), ("event_id", "int64"), ("version", "Int64"), ("accepted", "bool")), zip(*out))}) if out else pd.DataFrame(columns=["analysis_id", "event_id", "version", "accepted"])
        state.update((done,))

    return events.groupBy("analysis_id").applyInPandasWithState(fold, "analysis_id bigint, event_id bigint, version bigint, accepted boolean", "done bigint", "append", GroupStateTimeout.NoTimeout)
