"""Timed sittings as keyed state: each user's sitting opens with an event, counts answers, and closes by hand or when its time is up."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CLOSED = "user_id long, opened timestamp, closed timestamp, answers long, total long, reason string"
FOUND = "user_id long, opened long, closed long, answers long, total long, reason string"
OPEN = "users array<long>, opened array<long>, answers array<long>, total array<long>"
#: Bits of an id by which users are neighbours: 16 of them.
NEIGHBOURS = 4
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# The status that a click sets from each status; from any other it goes back to the first.
CYCLE, FIRST = {"unattempted": "review", "review": "mastered", "incorrect": "mastered"}, "unattempted"


def next_status(status: Column) -> Column:
    """The status after one click; null is unattempted."""
    out = F.when(status.isNull(), CYCLE[FIRST])
    for a, b in CYCLE.items():
        out = out.when(status == a, b)
    return out.otherwise(FIRST)


def clicked(states: Column) -> Column:
    """The status at the end of an ordered array of what happened: a null is a click, anything else sets the status."""
    return F.aggregate(states, F.lit(FIRST), lambda now, x: F.coalesce(x, next_status(now)))


def _sittings_of(minutes: int):
    """One open sitting a user: when it opened (microseconds), answers and their marks; a time-out stands at the first end of them.

    State is read and written once a batch for some neighbouring users, however many sittings open and close within. An event of a
    sitting whose time was up when it happened closes that one and opens the next. Rows later than the watermark are left out by Spark.
    """
    length = minutes * 60_000_000

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = {user: tuple(now) for user, *now in zip(*state.get, strict=True)} if state.exists else {}
        rows, out = [], []
        if not state.hasTimedOut:
            batch = pd.concat(batches).sort_values(["at", "event_id"])
            users = [None] * len(batch) if pd.isna(key[0]) else batch["user_id"].tolist()
            rows = zip(users, *(batch[c].tolist() for c in ("at", "marks", "submits")), strict=True)
        for user, at, marks, submits in rows:
            opened, answers, total = open_.get(user) or (at, 0, 0)
            if at >= opened + length:
                out.append((user, opened, opened + length, answers, total, "time"))
                opened, answers, total = at, 0, 0
            open_[user] = opened, answers + 1, total + int(marks)
            if submits:
                out.append((user, opened, at, answers + 1, total + int(marks), "submitted"))
                del open_[user]
        # time is up in milliseconds, as watermarks are; Spark calls where a time-out lies before the watermark
        passed = state.getCurrentWatermarkMs()
        for user in [user for user, now in open_.items() if (now[0] + length) // 1000 <= passed]:
            opened, answers, total = open_.pop(user)
            out.append((user, opened, opened + length, answers, total, "time"))
        if open_:
            state.update(tuple(map(list, zip(*((user, *now) for user, now in open_.items()), strict=True))))
            first = min(now[0] for now in open_.values())
            state.setTimeoutTimestamp(max((first + length) // 1000 - 1, passed + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in FOUND.split(", ")])

    return fold


def sittings(events: DataFrame, minutes: int, late: str) -> DataFrame:
    """A stream of closed sittings from events (user_id, ts, event_id, marks, submits): opened, closed, answers, total, reason.

    The first event after a sitting opens the next. It closes at the event that submits, at the first event after its time, or by
    itself once the watermark, ``late`` behind the latest event, has passed its end; its state then goes. ``2 ** NEIGHBOURS`` users of
    neighbouring ids share a row of state and a call, which costs more than their events.
    """
    rows = events.withWatermark("ts", late).withColumn("at", F.unix_micros("ts")).withColumn("users", F.shiftright("user_id", NEIGHBOURS))
    found = rows.groupBy("users").applyInPandasWithState(_sittings_of(minutes), FOUND, OPEN, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("user_id", *(F.timestamp_micros(c).alias(c) for c in ("opened", "closed")), "answers", "total", "reason")


def run_sittings(spark: SparkSession, events: DataFrame, minutes: int, late: str, out: str, checkpoint: str) -> DataFrame:
    """All input that is there now; closed sittings are appended to the Parquet folder ``out``. A later run with the same
    ``checkpoint`` goes on with the sittings that were open."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, PROVIDER)
    try:
        stream = sittings(events, minutes, late)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(CLOSED).parquet(out)
