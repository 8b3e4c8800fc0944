"""Streaming jobs with state of their own: rules over attempts in order, late patches, and tables merged by key."""

from __future__ import annotations

import datetime
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.utils import AnalysisException

from docspark.operators.attempts import SECOND, Rule

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # what states with timers need


class _InTurn(StatefulProcessor):
    """Holds a key's attempts until the watermark has passed them, so that none can come before, then runs the rule in
    order. A timer stands at the first that waits, or where a key's numbers are of no more use."""

    def __init__(self, rule: Rule, keep: int | None):
        self.rule, self.keep = rule, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id long, failed boolean")
        self.own = handle.getValueState("own", "numbers array<long>, last long")

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        self.waiting.appendList([(r["at"], r["event_id"], r["failed"]) for r in rows])
        yield from self._settle(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._settle(key, timerValues)

    def _settle(self, key, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        numbers, last = self.own.get() if self.own.exists() else ([], 0)
        due = [x for x in held if x[0] <= now]
        for at, event_id, failed in due:
            numbers, outcome = self.rule(list(numbers), at, failed)
            last = at
            yield Row(user_id=key[0], event_id=event_id, ts=datetime.datetime.fromtimestamp(at // SECOND).replace(microsecond=at % SECOND), outcome=outcome)
        rest = held[len(due) :]
        if rest:
            self.waiting.put(rest)
        elif held:
            self.waiting.clear()
        over = self.keep is not None and not rest and last + self.keep <= now
        if over or not numbers:
            self.own.clear()
        else:
            self.own.update((list(numbers), last))
        ends = [rest[0][0]] if rest else [last + self.keep] if self.keep is not None and numbers and not over else []
        for end in ends:
            self.handle.registerTimer(max(-(-end // 1000), now // 1000 + 1))

    def close(self) -> None:
        pass


def attempts_in_turn(events: DataFrame, rule: Rule, keep_seconds: int | None = None, flag: str | None = None, late: str = "1 minute") -> DataFrame:
    """(user_id, event_id, ts, outcome) of a stream of attempts (user_id, event_id, ts), as `attempts.in_turn` has them,
    whatever their order within `late`. A user's numbers go `keep_seconds` after their last attempt: a limiter's after its
    window, a locker's never, as failures in a row have no end."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    failed = F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(False)
    rows = events.where("user_id IS NOT NULL").withWatermark("ts", late).select("user_id", F.col("event_id").cast("long").alias("event_id"), "ts", failed.alias("failed"), F.unix_micros("ts").alias("at"))
    keep = None if keep_seconds is None else keep_seconds * SECOND
    shape = f"user_id {dict(events.dtypes)['user_id']}, event_id long, ts timestamp, outcome string"
    return rows.groupBy("user_id").transformWithState(statefulProcessor=_InTurn(rule, keep), outputStructType=shape, outputMode="Append", timeMode="EventTime")


def owner(user: str = "user_id", session: str = "session_id") -> Column:
    return F.coalesce(F.concat(F.lit("u:"), F.col(user).cast("string")), F.concat(F.lit("s:"), F.col(session)))


def patched_activity(activity: DataFrame, patches: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Searches of a stream with the patches of another one that come for the same search and owner within some time; a
    search without any comes out when its time is over, one with several comes out with each.

    activity: id, search_id, user_id, session_id, created_at, timing (map); patches: search_id, user_id, session_id, at,
    summary, summary_duration_ms. The duration goes into `timing` beside what is there; a missing summary or duration
    changes nothing. `patched_at` orders the rows of a search."""
    a = activity.withColumn("owner", owner()).withWatermark("created_at", late)
    p = patches.select(F.col("search_id").alias("p_search"), owner().alias("p_owner"), F.col("at").alias("patched_at"), "summary", "summary_duration_ms").withWatermark("patched_at", late)
    soon = (F.col("patched_at") >= F.col("created_at")) & (F.col("patched_at") <= F.col("created_at") + F.expr(f"INTERVAL {within}"))
    both = a.join(p, (F.col("search_id") == F.col("p_search")) & (F.col("owner") == F.col("p_owner")) & soon, "left_outer")
    timing = F.coalesce("timing", F.create_map().cast("map<string,double>"))
    longer = F.map_concat(F.map_filter(timing, lambda k, v: k != "summary_duration_ms"), F.create_map(F.lit("summary_duration_ms"), F.col("summary_duration_ms").cast("double")))
    both = both.withColumn("timing", F.when(F.col("summary_duration_ms").isNotNull(), longer).otherwise(F.col("timing")))
    return both.select("id", "search_id", "user_id", "session_id", "created_at", "timing", "summary", "patched_at")


class MergedTable:
    """A Parquet table of one row for each key, kept in buckets by the key's hash. A version holds the buckets that its
    batch touched, and says for each bucket which version has it; a batch that runs again writes the same version."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str, buckets: int = 16):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path, keys, order, buckets

    def _held(self, number: int) -> dict[int, int]:
        try:
            return {r["bucket"]: r["version"] for r in self.spark.read.schema("bucket int, version int").parquet(f"{self.path}/held/{number}").collect()}  # a row a bucket
        except AnalysisException:
            return {}

    def _rows(self, held: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.path}/data/{v}/bucket={b}" for b, v in sorted(held.items())]
        return self.spark.read.parquet(*paths) if paths else None

    def read(self, number: int) -> DataFrame | None:
        return self._rows(self._held(number))

    def merge(self, batch: DataFrame, number: int, alone: Column | None = None) -> None:
        """Take a batch in: of the rows of a key the one with the greatest `order` stays; rows for which `alone` holds are
        keys of their own."""
        parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in self.keys]
        single = F.coalesce(alone, F.lit(False)) if alone is not None else F.lit(False)
        key = F.when(single, F.concat(F.lit("alone:"), F.sha2(F.to_json(F.struct(*batch.columns)), 256))).otherwise(F.sha2(F.to_json(F.array(*parts)), 256))
        new = batch.withColumn("key", key).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))
        touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}  # `buckets` rows at most
        held = self._held(number - 1)
        old = self._rows({b: v for b, v in held.items() if b in touched})
        both = new.drop("bucket") if old is None else old.unionByName(new.drop("bucket"))
        rest = [c for c in both.columns if c not in ("key", self.order)]
        last = both.groupBy("key").agg(F.max(F.struct(self.order, *rest)).alias("r")).select("key", "r.*").select(*batch.columns, "key")
        last = last.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))
        last.repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{number}")
        held |= dict.fromkeys(touched, number)
        self.spark.createDataFrame(sorted(held.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/held/{number}")


def keep_ratings(ratings: DataFrame, path: str, checkpoint: str, buckets: int = 16) -> StreamingQuery:
    """Keeps the last rating of each user, type, reference and item of a stream (user_id, rating_type, reference_id, item_id,
    score, updated_at and an id); a missing item is an empty one, and ratings without a user all stay."""

    def write(batch: DataFrame, number: int) -> None:
        table = MergedTable(batch.sparkSession, path, ["user_id", "rating_type", "reference_id", "item_id"], "updated_at", buckets)
        table.merge(batch, number, F.col("user_id").isNull())

    return ratings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def flag_rated(activity: DataFrame, ratings: DataFrame) -> DataFrame:
    """Searches with `has_ratings`: whether their user rated one of their results or their summary."""
    rated = ratings.where("user_id IS NOT NULL AND rating_type IN ('search_result', 'ai_summary')").select("user_id", F.col("reference_id").alias("search_id")).distinct()
    return activity.join(rated.withColumn("has_ratings", F.lit(True)), ["user_id", "search_id"], "left").withColumn("has_ratings", F.coalesce("has_ratings", F.lit(False)))
