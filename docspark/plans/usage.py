"""Registered queries over usage, ratings and processing events."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.operators import attempts, stats, usage
from docspark.plans.registry import query
from docspark.plans.views import view


def events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet")


def stages(spark, sf):
    return view(spark, sf, "v_stage_events")


@query("a13_export_rows", """SELECT id, user_id, query, nullif(round(CAST(search_duration_ms AS DECIMAL(20, 8)) * 0.001, 2)::DOUBLE, 0) AS seconds, repeat(query, 100 + id % 100)[1:997] || CASE WHEN length(repeat(query, 100 + id % 100)) > 1000 THEN '...' ELSE substr(repeat(query, 100 + id % 100), 998) END AS summary, created_at FROM v_activity""")
def a13(spark, sf):
    a = view(spark, sf, "v_activity")
    return usage.export_rows(a.withColumn("summary", F.repeat(F.col("query"), (F.lit(100) + F.col("id") % 100).cast("int"))))


@query("c12_activity_with_user", """SELECT id, email FROM v_activity a LEFT JOIN v_users u USING (user_id) WHERE coalesce(email ILIKE '%12%', false) OR query ILIKE '%12%'""")
def c12(spark, sf):
    return usage.activity_with_user(view(spark, sf, "v_activity"), view(spark, sf, "v_users"), "12").select("id", "email")


@query("c13_rated_flag", """SELECT id, search_id IN (SELECT reference_id FROM v_ratings WHERE rating_type IN ('search_result', 'ai_summary')) AS rated FROM v_activity""")
def c13(spark, sf):
    return usage.rated_flag(view(spark, sf, "v_activity"), view(spark, sf, "v_ratings")).select("id", "rated")


@query("d24_thread_counts", """SELECT thread_id, count(*) AS messages, max(turn) AS last_turn FROM v_messages GROUP BY 1""")
def d24(spark, sf):
    return stats.thread_counts(view(spark, sf, "v_messages"))


@query("d34_latency_summary", """SELECT query, min(search_duration_ms) AS low, round(avg(search_duration_ms), 6) AS mean, quantile_disc(search_duration_ms, 0.5) AS p50, quantile_disc(search_duration_ms, 0.9) AS p90, max(search_duration_ms) AS high FROM v_activity WHERE search_duration_ms IS NOT NULL GROUP BY 1""")
def d34(spark, sf):
    return stats.latency_summary(view(spark, sf, "v_activity"), "query", "search_duration_ms")


@query("f14_page_activity", """SELECT id, search_duration_ms FROM v_activity ORDER BY search_duration_ms ASC NULLS LAST, id LIMIT 40""")
def f14(spark, sf):
    return usage.page_activity(view(spark, sf, "v_activity"), "search_duration_ms", False, 40).select("id", "search_duration_ms")


@query("d20_throughput", """WITH d AS (SELECT doc_id, max("at") AS t FROM v_stage_events WHERE stage = 'index' AND success GROUP BY 1) SELECT date_trunc('hour', t) AS hour, count(*) AS documents, coalesce(sum(sys_page_count), 0)::BIGINT AS pages FROM d LEFT JOIN v_docs USING (doc_id) GROUP BY 1""")
def d20(spark, sf):
    return stats.throughput(stages(spark, sf), view(spark, sf, "v_docs").select("doc_id", F.col("sys_page_count").alias("page_count")))


@query("d21_phase_distribution", """WITH h AS (SELECT date_trunc('hour', "at") AS hour, stage, sum(elapsed_seconds) AS s FROM v_stage_events GROUP BY 1, 2) SELECT hour, stage, round(coalesce(s / nullif(sum(s) OVER (PARTITION BY hour), 0), 0), 6) AS share FROM h""")
def d21(spark, sf):
    return stats.phase_distribution(stages(spark, sf))


@query("d22_error_histogram", """WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "at" DESC, event_id DESC) AS k FROM v_stage_events) q WHERE k = 1) SELECT date_trunc('hour', "at") AS hour, count(*) AS documents, count(*) FILTER (NOT success) AS errors FROM l GROUP BY 1""")
def d22(spark, sf):
    return stats.error_histogram(stages(spark, sf))


@query("d23_phase_intervals", """SELECT event_id, doc_id, stage, make_timestamp(epoch_us("at") - CAST(round(elapsed_seconds * 1000000) AS BIGINT)) AS start_at, "at" AS end_at FROM v_stage_events""")
def d23(spark, sf):
    return stats.phase_intervals(stages(spark, sf))


@query("d36_mean_relevance", """SELECT config, round(avg(m), 6) AS relevance FROM (SELECT event_type AS config, user_id, avg(value) AS m FROM events GROUP BY 1, 2) q GROUP BY 1""")
def d36(spark, sf):
    return stats.mean_relevance(events(spark, sf).select(F.col("event_type").alias("config"), F.col("user_id").alias("query_id"), F.col("value").alias("score")))


@query("d38_tree_nodes", """SELECT event_id, 1 + event_id % 5 + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS nodes FROM events""")
def d38(spark, sf):
    """A root with up to four children, some with a grandchild, and texts that look like nodes."""
    note = F.lit(', "text": "see \\"id\\": 7, {\\"id\\": 8}", "tags": ["id", "\\"id\\":"]')
    leaf = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), note, F.lit("}"))
    below = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(', "more": ['), leaf, F.lit("]"))).otherwise("")
    children = F.array_join(F.array_repeat(leaf, (F.col("event_id") % 5).cast("int")), ", ")
    tree = F.concat(F.lit('{"id": "root"'), note, F.lit(', "children": ['), children, F.lit("]"), below, F.lit("}"))
    return stats.tree_nodes(events(spark, sf).withColumn("tree", tree), "tree").select("event_id", F.col("nodes").cast("long").alias("nodes"))


@query("i02_tumbling_batch", """SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def i02(spark, sf):
    return usage.hourly_counts(events(spark, sf))


@query("i05_rate_breaches_batch", """SELECT event_id, attempts FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND CURRENT ROW) AS attempts FROM events) q WHERE attempts > 4""")
def i05(spark, sf):
    return usage.rate_breaches(events(spark, sf), limit=4, seconds=86400).select("event_id", "attempts")


@query("i06_lockouts_batch", """WITH r AS (SELECT *, sum(CASE WHEN event_id % 4 <> 0 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events) SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS k FROM r WHERE event_id % 4 <> 0) q WHERE k % 5 = 0""")
def i06(spark, sf):
    return usage.lockouts(events(spark, sf).withColumn("failed", F.col("event_id") % 4 != 0))


ATTEMPTS = "a AS (SELECT event_id, user_id, ts, epoch_us(ts) AS at_us, event_id % 4 <> 0 AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"


@query("i05b_rate_limit", f"""WITH RECURSIVE {ATTEMPTS}, z AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, []::BIGINT[] AS log, '' AS outcome FROM a WHERE n = 1 UNION ALL
SELECT a.user_id, a.n, a.event_id, CASE WHEN len(list_filter(log, lambda t: t > at_us - 86400000000)) >= 3 THEN list_filter(log, lambda t: t > at_us - 86400000000) ELSE list_append(list_filter(log, lambda t: t > at_us - 86400000000), at_us) END,
CASE WHEN len(list_filter(log, lambda t: t > at_us - 86400000000)) >= 3 THEN 'blocked' ELSE 'passed' END FROM z JOIN a ON a.user_id = z.user_id AND a.n = z.n + 1)
SELECT event_id, user_id, outcome FROM z WHERE n > 0""")
def i05b(spark, sf):
    """Three attempts in a day."""
    return attempts.in_turn(events(spark, sf), attempts.limiter(3, 86400)).drop("ts")


@query("i06b_locks", f"""WITH RECURSIVE {ATTEMPTS}, z AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, 0::BIGINT AS k, 0::BIGINT AS till, '' AS outcome FROM a WHERE n = 1 UNION ALL
SELECT a.user_id, a.n, a.event_id, CASE WHEN till > at_us THEN k WHEN NOT failed THEN 0 ELSE k + 1 END, CASE WHEN till > at_us THEN till WHEN failed AND k + 1 >= 5 THEN at_us + 3000 * 60000000::BIGINT ELSE 0 END,
CASE WHEN till > at_us THEN 'locked' WHEN NOT failed THEN 'success' WHEN k + 1 >= 5 THEN 'lock' ELSE 'failure' END FROM z JOIN a ON a.user_id = z.user_id AND a.n = z.n + 1)
SELECT event_id, user_id, outcome FROM z WHERE n > 0""")
def i06b(spark, sf):
    """Five failures in a row lock for fifty hours."""
    e = events(spark, sf).withColumn("failed", F.col("event_id") % 4 != 0)
    return attempts.in_turn(e, attempts.locker(5, 3000), flag="failed").drop("ts")


@query("i07_sessions_batch", """WITH g AS (SELECT *, CASE WHEN coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 43200000000, true) THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g)
SELECT user_id, min(ts) AS start_at, max(ts) AS end_at, count(*) AS events FROM s GROUP BY user_id, s""")
def i07(spark, sf):
    return usage.sessions(events(spark, sf), minutes=720)


@query("i08_late_summaries_batch", """SELECT id, CASE WHEN id % 3 = 0 THEN 'summary ' || search_id END AS summary FROM v_activity""")
def i08(spark, sf):
    a = view(spark, sf, "v_activity")
    late = a.where("id % 3 = 0").select("search_id", "user_id", "session_id", F.concat(F.lit("summary "), "search_id").alias("summary"), F.col("created_at").alias("at"))
    return usage.late_summaries(a, late).select("id", "summary")


@query("i09_latest_ratings_batch", """SELECT id, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id, rating_type, reference_id, coalesce(item_id, '') ORDER BY id DESC) AS k FROM v_ratings) q WHERE user_id IS NULL OR k = 1""")
def i09(spark, sf):
    return usage.latest_ratings(view(spark, sf, "v_ratings")).select("id", "score")


@query("h09_status_timestamp", """SELECT doc_id, max("at") AS status_at FROM (SELECT doc_id, stage, max("at") AS "at" FROM v_stage_events GROUP BY 1, 2) q GROUP BY 1""")
def h09(spark, sf):
    per = stages(spark, sf).groupBy("doc_id", "stage").agg(F.max("at").cast("string").alias("at"))
    m = per.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("stage", F.struct("at").alias("v")))).alias("stages"))
    return m.select("doc_id", usage.status_timestamp(F.col("stages")).alias("status_at"))


@query("h12_page_count", """SELECT doc_id, CASE WHEN CAST(doc_id AS INT) % 2 = 0 THEN sys_page_count ELSE 12 END AS pages FROM v_docs""")
def h12(spark, sf):
    explicit = F.when(F.col("doc_id").cast("int") % 2 == 0, F.col("sys_page_count"))
    return view(spark, sf, "v_docs").select("doc_id", usage.page_count(explicit, F.lit(0), F.lit("page 3 | page 12 | page 7")).alias("pages"))
