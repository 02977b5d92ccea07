"""Structured Streaming forms: the same results as the batch operators, as files arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState


def event_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 10) -> DataFrame:
    """Rows of the Parquet files of a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def daily_quota(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Events by UTC day and type, late rows within `lateness` included; each event_id counts once."""
    known = events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])
    return known.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("events")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "events")


def failure_counts(attempts: DataFrame) -> DataFrame:
    """(url, failures, attempts) after each batch of a stream of (id, url, attempted_at, bad): failures since the last success.

    State is one row a url: the counters and the place of the last attempt counted. Attempts are taken in order within a
    batch; one that lies before what was counted already, or is delivered again, changes nothing. Null urls are left out.
    """

    def step(key: tuple[str], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, count, at, last = state.get if state.exists else (0, 0, -(2**63), -(2**63))
        for part in parts:
            us = part["attempted_at"].astype("datetime64[us]").astype("int64")
            for t, i, bad in sorted(zip(us.tolist(), part["id"].tolist(), part["bad"].tolist())):
                if (t, i) > (at, last):
                    failures, count, at, last = (failures + 1 if bad else 0), count + 1, t, i
        state.update((failures, count, at, last))
        yield pd.DataFrame({"url": [key[0]], "failures": [failures], "attempts": [count]})

    shape = "failures long, attempts long, at long, last long"
    return attempts.filter("url is not null").groupBy("url").applyInPandasWithState(step, "url string, failures long, attempts long", shape, "update", "NoTimeout")


def append_new(stream: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Appends rows whose keys the Parquet table at `path` lacks; a batch that is replayed adds nothing."""

    def store(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(keys)
        try:
            rows = rows.join(batch.sparkSession.read.schema(batch.schema).parquet(path).select(*keys), keys, "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rows.select(*batch.columns).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_table(result: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Runs a stream over what is there and leaves the result in the in-memory table `name`; for small results."""
    return result.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
