"""Usage, ratings, rate limits and sessions, in their batch forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def export_rows(activity: DataFrame) -> DataFrame:
    """Export rows: long summaries cut to 997 characters and dots, milliseconds as seconds with two digits, none for 0."""
    seconds = F.nullif(F.round(F.col("search_duration_ms") / 1000, 2), F.lit(0.0))
    summary = F.when(F.length("summary") > 1000, F.concat(F.substring("summary", 1, 997), F.lit("..."))).otherwise(F.col("summary"))
    return activity.select("id", "user_id", "query", seconds.alias("seconds"), summary.alias("summary"), "created_at")


def activity_with_user(activity: DataFrame, users: DataFrame, search: str) -> DataFrame:
    j = activity.join(users.select("user_id", "email"), "user_id", "left")
    return j.where(F.coalesce(F.col("email").ilike(f"%{search}%"), F.lit(False)) | F.col("query").ilike(f"%{search}%"))


def rated_flag(activity: DataFrame, ratings: DataFrame) -> DataFrame:
    """Whether a search result or summary of the search was rated."""
    rated = ratings.where(F.col("rating_type").isin("search_result", "ai_summary")).select(F.col("reference_id").alias("search_id"), F.lit(True).alias("rated")).distinct()
    return activity.join(rated, "search_id", "left").withColumn("rated", F.coalesce("rated", F.lit(False)))


def page_activity(df: DataFrame, key: str, descending: bool, size: int) -> DataFrame:
    """The first page by a key whose missing values come last either way."""
    order = F.desc_nulls_last(key) if descending else F.asc_nulls_last(key)
    return df.orderBy(order, "id").limit(size)


def hourly_counts(events: DataFrame) -> DataFrame:
    """Events by hour and type."""
    return events.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"))


def rate_breaches(events: DataFrame, user: str = "user_id", at: str = "ts", limit: int = 10, seconds: int = 60) -> DataFrame:
    """Attempts with more than `limit` attempts of the user in the window that ends with them."""
    t = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(user).orderBy(t).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("attempts", F.count("*").over(w)).where(F.col("attempts") > limit)


def lockouts(events: DataFrame, user: str = "user_id", at: str = "ts", failed: str = "failed", limit: int = 5) -> DataFrame:
    """Attempts that complete `limit` failures in a row since the user's last success or lock."""
    w = Window.partitionBy(user).orderBy(at, "event_id")
    run = F.sum(F.when(F.col(failed), 0).otherwise(1)).over(w)
    streak = F.row_number().over(Window.partitionBy(user, "run").orderBy(at, "event_id"))
    rows = events.withColumn("run", run).where(failed)
    return rows.withColumn("streak", streak).where(F.col("streak") % limit == 0).select("event_id", user, at)


def sessions(events: DataFrame, user: str = "user_id", at: str = "ts", minutes: int = 30) -> DataFrame:
    """Runs of a user's events with gaps below the limit: start, end and number of events."""
    w = Window.partitionBy(user).orderBy(at, "event_id")
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp")) >= minutes * 60_000_000
    numbered = events.withColumn("s", F.sum(F.when(F.coalesce(gap, F.lit(True)), 1).otherwise(0)).over(w))
    return numbered.groupBy(user, "s").agg(F.min(at).alias("start_at"), F.max(at).alias("end_at"), F.count("*").alias("events")).drop("s")


def latest_ratings(ratings: DataFrame) -> DataFrame:
    """The last rating per user, type, reference and item; anonymous ones all stay."""
    w = Window.partitionBy("user_id", "rating_type", "reference_id", F.coalesce("item_id", F.lit(""))).orderBy(F.desc("id"))
    kept = ratings.withColumn("turn", F.when(F.col("user_id").isNull(), 1).otherwise(F.row_number().over(w)))
    return kept.where("turn = 1").drop("turn")


def late_summaries(searches: DataFrame, summaries: DataFrame) -> DataFrame:
    """Searches patched with the summary that came later for the same search and owner."""
    owner = lambda: F.coalesce(F.col("user_id").cast("string"), F.col("session_id"))
    s = summaries.select("search_id", owner().alias("owner"), F.col("summary").alias("late"), F.col("at").alias("late_at"))
    last = s.groupBy("search_id", "owner").agg(F.max_by("late", "late_at").alias("late"))
    return searches.withColumn("owner", owner()).join(last, ["search_id", "owner"], "left").withColumn("summary", F.col("late")).drop("late", "owner")


def page_count(explicit: Column, staged: Column, text: Column) -> Column:
    """The first positive number given, else the largest `page N` of a text."""
    found = F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"page (\d+)"), F.lit(1)), lambda x: x.try_cast("int")))
    return F.coalesce(F.when(explicit > 0, explicit), F.when(staged > 0, staged), found)


def status_timestamp(stages: Column) -> Column:
    """The latest readable time of a map of stage structs."""
    return F.array_max(F.transform(F.map_values(stages), lambda s: F.try_to_timestamp(s["at"])))


def update_stage(stages: Column, stage: str, entry: Column) -> Column:
    """The map with one stage replaced."""
    return F.map_concat(F.map_filter(stages, lambda k, v: k != stage), F.create_map(F.lit(stage), entry))
