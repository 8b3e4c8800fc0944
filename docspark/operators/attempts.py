"""Rules over attempts in their order: a sliding limit that blocked attempts don't count towards, and locks.

A rule is a step from a short list of numbers, which is all that it remembers of a key, to the next one and the attempt's
outcome. `in_turn` runs it over a table, the streaming job `attempts_in_turn` over a stream; both take attempts by time,
then by id.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECOND = 1_000_000  # times are microseconds
Rule = Callable[[list[int], int, bool], tuple[list[int], str]]


def limiter(limit: int = 10, seconds: int = 60) -> Rule:
    """`blocked` from `limit` attempts within the last seconds on, which only those that passed count towards. It
    remembers when these were."""

    def step(own: list[int], at: int, failed: bool) -> tuple[list[int], str]:
        log = [t for t in own if t > at - seconds * SECOND]
        return (log, "blocked") if len(log) >= limit else ([*log, at], "passed")

    return step


def locker(limit: int = 5, minutes: int = 15) -> Rule:
    """`lock` with a failure that is the `limit`-th in a row or later, for some minutes in which attempts are `locked` and
    count for nothing; a success starts over. It remembers the failures and when the lock ends."""

    def step(own: list[int], at: int, failed: bool) -> tuple[list[int], str]:
        n, until = own or (0, 0)
        if until > at:
            return [n, until], "locked"
        if not failed:
            return [], "success"
        return ([n + 1, at + minutes * 60 * SECOND], "lock") if n + 1 >= limit else ([n + 1, 0], "failure")

    return step


def in_turn(events: DataFrame, rule: Rule, key: str = "user_id", flag: str | None = None) -> DataFrame:
    """(key, event_id, ts, outcome) of all attempts. Rows are dealt by key and sorted; a task reads them once and holds the
    numbers of one key, whatever the number of its attempts. Rows without key or time are left out."""
    failed = F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(False)
    rows = events.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(key, "event_id", "ts", failed.alias("failed"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    rows = rows.repartition(key).sortWithinPartitions(key, "at", "event_id")

    def run(batches):
        held, own = None, []
        for batch in batches:
            said = []
            for k, at, bad in zip(*(batch[c].to_pylist() for c in (key, "at", "failed")), strict=True):
                held, own = k, own if k == held else []
                own, outcome = rule(own, at, bad)
                said.append(outcome)
            yield pa.RecordBatch.from_arrays([batch[key], batch["event_id"], batch["ts"], pa.array(said, pa.string())], names=[key, "event_id", "ts", "outcome"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"{key} {kinds[key]}, event_id {kinds['event_id']}, ts {kinds['ts']}, outcome string")
