"""Scan events as a stream: queue flushes, rolling metrics and rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCAN = "event_id long, store_id long, ean long, scanned_at timestamp, created_at timestamp, retries int"


def queued_scans(spark: SparkSession, folder: str, files_per_batch: int = 50) -> DataFrame:
    """Scans queued as JSON files; those retried three times are dropped, and the client's event time is kept."""
    raw = spark.readStream.schema(SCAN).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return raw.filter("coalesce(retries, 0) < 3").withColumn("scanned_at", F.coalesce("scanned_at", "created_at"))


def flush(scans: DataFrame, target: str, checkpoint: str, once_per_event: bool = False, every: str | None = None) -> StreamingQuery:
    """Appends batches of scans to a Parquet table, whole or not at all.

    once_per_event drops repeats of an event id within a day. every is a trigger interval; without one, what is
    queued is flushed and the query ends.
    """
    out = scans.withWatermark("scanned_at", "1 day").dropDuplicatesWithinWatermark(["event_id"]) if once_per_event else scans

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is run again replaces its own folder
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = out.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def rolling_counts(scans: DataFrame, width: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Scans of each store in sliding windows of event time."""
    return scans.withWatermark("scanned_at", late).groupBy(F.window("scanned_at", width, slide), "store_id").agg(F.count("*").alias("scans"))


def admit(times: list[float], start: float | None, used: int, limit: int, window: float) -> tuple[list[bool], float | None, int]:
    """Which requests at sorted times pass; a window starts with the first request after the last one ended."""
    out = []
    for t in times:
        if start is None or t - start > window:
            start, used = t, 0
        used += 1
        out.append(used <= limit)
    return out, start, used


def rate_limit(requests: DataFrame, window: float = 60.0) -> DataFrame:
    """request_id, allowed of requests(request_id, key, at double, max_requests int), a batch.

    A key's requests are taken in order, as each decision rests on the one before; the limit is that of its first.
    They pass through one task in batches, sorted by Spark, with only the window's start and count carried on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, start, used, limit = None, None, 0, 0
        first = True
        for batch in batches:
            allowed = []
            for k, at, most in zip(*(batch.column(c).to_pylist() for c in ("key", "at", "max_requests"))):
                if first or k != key:
                    first, key, start, used, limit = False, k, None, 0, int(most)
                ok, start, used = admit([at], start, used, limit, window)
                allowed += ok
            yield pa.RecordBatch.from_arrays([batch.column("request_id").cast(pa.int64()), pa.array(allowed, pa.bool_())], ["request_id", "allowed"])

    dealt = requests.select("request_id", "key", "at", "max_requests").repartition("key").sortWithinPartitions("key", "at", "request_id")
    return dealt.mapInArrow(run, "request_id long, allowed boolean")


def rate_limit_stream(requests: DataFrame, window: float = 60.0) -> DataFrame:
    """The same over a stream; a key's window is its state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, used = state.get if state.exists else (None, 0)
        pdf = pd.concat(batches).sort_values(["at", "request_id"])
        ok, start, used = admit(pdf["at"].tolist(), start, used, int(pdf["max_requests"].iloc[0]), window)
        state.update((start, used))
        yield pd.DataFrame({"request_id": pdf["request_id"], "allowed": ok})

    return requests.groupBy("key").applyInPandasWithState(
        run, "request_id long, allowed boolean", "start double, used int", "append", GroupStateTimeout.NoTimeout
    )
