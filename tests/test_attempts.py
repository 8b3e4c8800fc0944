"""Rules over attempts, late patches and merged tables: streams against plain loops."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from docspark.operators import attempts
from docspark.streaming import keyed

START = datetime.datetime(2024, 1, 1)


def some_attempts(seed, users=4, n=160):
    rng = random.Random(seed)
    at, rows = 0.0, []
    for i in range(n):
        at += rng.choice([0, 0.2, 1, 3, 20, 70])
        rows.append((i, rng.randrange(users), START + datetime.timedelta(seconds=at), rng.random() < 0.8))
    return rows


def plain(rows, limit, seconds, locks, minutes):
    """Outcomes of both rules by event."""
    passed, state, out = {}, {}, {}
    for i, user, at, failed in sorted(rows, key=lambda r: (r[2], r[0])):
        log = [t for t in passed.get(user, []) if t > at - datetime.timedelta(seconds=seconds)]
        first = "blocked" if len(log) >= limit else "passed"
        passed[user] = log if first == "blocked" else [*log, at]
        n, until = state.get(user, (0, START))
        if until > at:
            second = "locked"
        elif not failed:
            second, state[user] = "success", (0, START)
        else:
            second = "lock" if n + 1 >= locks else "failure"
            state[user] = (n + 1, at + datetime.timedelta(minutes=minutes) if second == "lock" else START)
        out[i] = (first, second)
    return out


SCHEMA = "event_id long, user_id long, ts timestamp, failed boolean"
RULES = {"limit": (attempts.limiter(3, 60), None), "lock": (attempts.locker(4, 2), "failed")}


@pytest.mark.parametrize("name", RULES)
def test_outcomes_of_a_table(spark, name):
    rows = some_attempts(1)
    rule, flag = RULES[name]
    df = spark.createDataFrame([*rows, (900, None, START, True), (901, 1, None, True)], SCHEMA).repartition(5, F.rand(3))
    want = plain(rows, 3, 60, 4, 2)
    assert {r.event_id: r.outcome for r in attempts.in_turn(df, rule, flag=flag).collect()} == {i: x[name == "lock"] for i, x in want.items()}
    assert len({x[name == "lock"] for x in want.values()}) == (4 if name == "lock" else 2)
    assert attempts.in_turn(df.limit(0), rule, flag=flag).count() == 0


@pytest.mark.parametrize("name", RULES)
def test_outcomes_of_a_shuffled_stream(spark, tmp_path, name):
    """Files hold attempts out of order by up to the allowed lateness; one far ahead lets all others settle."""
    rows = some_attempts(2, users=3, n=90)
    rule, flag = RULES[name]
    rng = random.Random(7)
    shuffled = sorted(rows, key=lambda r: r[2] + datetime.timedelta(seconds=rng.uniform(0, 50)))
    parts = [shuffled[k : k + 30] for k in range(0, len(rows), 30)] + [[(999, 7, START + datetime.timedelta(days=1), False)]]
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = keyed.attempts_in_turn(s, rule, keep_seconds=60 if name == "limit" else None, flag=flag)
    q = got.writeStream.format("memory").queryName(f"turns_{name}").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    out = {r.event_id: (r.outcome, r.ts) for r in spark.table(f"turns_{name}").collect()}
    want = plain(rows, 3, 60, 4, 2)
    assert {i: x[0] for i, x in out.items() if i != 999} == {i: x[name == "lock"] for i, x in want.items()}
    assert all(out[i][1] == at for i, _, at, _ in rows)


def test_late_patches_reach_their_search(spark, tmp_path):
    t = lambda m: START + datetime.timedelta(minutes=m)
    searches = [[(1, "q1", 5, None, t(0), {"search_ms": 9.0}), (2, "q2", None, "s", t(1), None), (3, "q3", 5, None, t(2), None)], [(4, "far", 9, None, t(900), None)]]
    patches = [[("q1", 5, None, t(3), "one", None), ("q1", 5, None, t(5), None, 70), ("q2", None, "other", t(4), "not mine", 1), ("q3", 5, None, t(200), "too late", 2)], [("none", 1, None, t(901), "x", 1)]]
    a_shape = "id int, search_id string, user_id long, session_id string, created_at timestamp, timing map<string,double>"
    p_shape = "search_id string, user_id long, session_id string, at timestamp, summary string, summary_duration_ms int"
    streams = []
    for name, batches, shape in (("a", searches, a_shape), ("p", patches, p_shape)):
        for rows in batches:
            spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        streams.append(spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)))
    q = keyed.patched_activity(*streams).writeStream.format("memory").queryName("patched").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    got = [(r.id, r.summary, r.timing) for r in spark.table("patched").collect() if r.id < 4]
    assert sorted(map(str, got)) == sorted(map(str, [(1, "one", {"search_ms": 9.0}), (1, None, {"search_ms": 9.0, "summary_duration_ms": 70.0}), (2, None, None), (3, None, None)]))


def test_ratings_are_merged_into_the_buckets_they_touch(spark, tmp_path):
    shape = "id long, user_id long, rating_type string, reference_id string, item_id string, score int, updated_at timestamp"
    t = lambda m: START + datetime.timedelta(minutes=m)
    batches = [
        [(1, 1, "search_result", "a", None, 1, t(0)), (2, 1, "search_result", "a", "", 2, t(1)), (3, None, "ai_summary", "a", None, 3, t(2)), (4, None, "ai_summary", "a", None, 3, t(2)), *((10 + k, k, "ai_summary", "b", "x", k, t(3)) for k in range(2, 40))],
        [(5, 1, "search_result", "a", None, 5, t(9)), (6, 1, "search_result", "a", None, 4, t(8))],
    ]
    for rows in batches:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    keyed.keep_ratings(s, str(tmp_path / "out"), str(tmp_path / "cp"), buckets=8).awaitTermination()
    table = keyed.MergedTable(spark, str(tmp_path / "out"), ["user_id", "rating_type", "reference_id", "item_id"], "updated_at", 8)
    got = {r.id: r.score for r in table.read(1).collect()}
    assert got == {5: 5, 3: 3, 4: 3, **{10 + k: k for k in range(2, 40)}}
    assert len(table._held(0)) > 4 and [b for b, v in table._held(1).items() if v == 1] and sum(v == 1 for v in table._held(1).values()) == 1
    before = sorted(map(str, table.read(1).collect()))
    table.merge(spark.createDataFrame(batches[1], shape), 1, F.col("user_id").isNull())  # a batch that runs again
    assert sorted(map(str, table.read(1).collect())) == before
    activity = spark.createDataFrame([(1, "a"), (2, "b"), (2, "a"), (None, "a")], "user_id long, search_id string")
    flagged = keyed.flag_rated(activity, table.read(1))
    assert {(r.user_id, r.search_id): r.has_ratings for r in flagged.collect()} == {(1, "a"): True, (2, "b"): True, (2, "a"): False, (None, "a"): False}
