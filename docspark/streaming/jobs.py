"""Structured Streaming jobs. Each takes a streaming DataFrame; late data is bounded by `late`."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructField, StructType

from docspark.operators import repairs

LATE = "1 hour"


def hourly_counts(events: DataFrame, late: str = LATE) -> DataFrame:
    """Events by hour and type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


def mark_duplicates(docs: DataFrame, late: str = LATE) -> DataFrame:
    """The first document of each checksum within the bound."""
    return docs.withWatermark("ts", late).dropDuplicatesWithinWatermark(["sys_file_checksum"])


def rate_breaches(events: DataFrame, limit: int = 10, late: str = "1 minute") -> DataFrame:
    """Sliding windows of 60 seconds with more than `limit` attempts of a user."""
    w = F.window("ts", "60 seconds", "1 second")
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("attempts")).where(F.col("attempts") > limit).select("user_id", F.col("w.end").alias("at"), "attempts")


def sessions(events: DataFrame, minutes: int = 30, late: str = LATE) -> DataFrame:
    w = F.session_window("ts", f"{minutes} minutes")
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start_at"), "events")


def stage_timeouts(events: DataFrame, seconds: int = 7200, late: str = LATE) -> DataFrame:
    """(doc_id, status): `stopped` for documents whose last stage has no result within `seconds`. A finished stage clears
    the document, so only what is open when its time is up comes out."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"doc_id": [key[0]], "status": ["stopped"]})
            return
        rows = pd.concat(list(batches))
        at = rows["ts"].map(lambda t: int(t.value // 1000))
        last, finished = (state.get if state.exists else (-1, False))
        newest = int(at.max())
        if newest >= last:
            last, finished = newest, bool(rows.loc[at == newest, "finished"].any())
        if finished:
            if state.exists:
                state.remove()
            return
        state.update((last, finished))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    return events.withWatermark("ts", late).groupBy("doc_id").applyInPandasWithState(step, "doc_id string, status string", "last long, finished boolean", "append", GroupStateTimeout.EventTimeTimeout)


def ingest(scans: DataFrame, path: str, checkpoint: str, key: str = "doc_id") -> StreamingQuery:
    """Keeps a table of documents up to date with scanned ones (doc_id, sys_status, the three checksums and `ts`): each
    batch's last scan of a document is compared with the table, and new, changed and failed ones are written over it."""

    def write(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c != key]
        last = batch.groupBy(key).agg(F.max_by(F.struct(*rest), "ts").alias("r")).select(key, "r.*")
        shape = StructType([*batch.drop("ts").schema, StructField("change", StringType())])
        old = batch.sparkSession.read.schema(shape).parquet(f"{path}/v={number - 1}") if number else batch.sparkSession.createDataFrame([], shape)
        diff = repairs.change_type(last.drop("ts"), old.drop("change"), key).where("change <> 'unchanged'")
        new = diff.withColumn("sys_status", F.col("effective_status")).drop("effective_status").select(*shape.names)
        old.join(new.select(key), key, "left_anti").unionByName(new).write.mode("overwrite").parquet(f"{path}/v={number}")

    return scans.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lockouts(events: DataFrame, limit: int = 5, late: str = LATE) -> DataFrame:
    """(user_id, failures): a row whenever a user's failures in a row reach the limit; a success starts over."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        locks = 0
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for failed in rows["failed"]:
            n = n + 1 if failed else 0
            if n == limit:
                locks, n = locks + 1, 0
        state.update((n,))
        if locks:
            yield pd.DataFrame({"user_id": [key[0]], "locks": [locks]})

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(step, "user_id long, locks int", "n int", "append", GroupStateTimeout.NoTimeout)


def upsert_stream(changes: DataFrame, path: str, key: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Keeps a Parquet table of the last row of each key: each batch writes a new version folder and the pointer is its
    number, so a batch that runs again writes the same version."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/v={number - 1}") if number else batch.limit(0)
        both = old.unionByName(batch)
        rest = [c for c in both.columns if c not in key]
        last = both.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")
        last.write.mode("overwrite").parquet(f"{path}/v={number}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None, then: Callable | None = None) -> StreamingQuery:
    """Read everything there is now into the in-memory table `name` (tests and small reports)."""
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    q.awaitTermination()
    return q
