"""Run states of jobs, watched on a stream of their rows.

A job is STARTING and RUNNING with its first row.  It becomes PAUSED when its time is up,
TRIPWIRE when it gives no row for too long or its first rows are too bad or too slow,
COMPLETED or FAILED with a row that says so.  Only RUNNING jobs change, except that a
PAUSED one starts anew with a row that says so, with a new time and new first rows.

Time is that of the rows, so a replay gives the same states as a stream that was
stopped and resumed, and as the batch form.  A job's rows must come in order of time but for
those of one micro-batch; of rows of one time those with the smaller id come first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: States of a run, and which may follow which.
FOLLOWS = {None: {"STARTING"}, "STARTING": {"RUNNING"}, "RUNNING": {"PAUSED", "TRIPWIRE", "COMPLETED", "FAILED"}, "PAUSED": {"STARTING"}, "TRIPWIRE": set(), "COMPLETED": set(), "FAILED": set()}
STATES = "job long, attempt int, state string, at timestamp, reason string"
_STATE = "state string, attempt int, first_us long, last_us long, n int, bad int, seconds double"


@dataclass(frozen=True)
class Limits:
    """stall_us: longest time without a row; deadline_us: longest time of an attempt; first: rows that are judged, by the share of bad ones and their mean seconds against a reference."""

    stall_us: int
    deadline_us: int
    first: int = 20
    bad_share: float = 0.5
    reference: float = 1.0
    times: float = 3.0


def _at(us: int) -> datetime:
    return datetime.fromtimestamp(us // 10**6, timezone.utc).replace(microsecond=us % 10**6, tzinfo=None)


def due(s: list, limits: Limits) -> tuple[int, str, str]:
    """When a running job ends if no row comes; its time being up goes before a stall at the same moment."""
    return min((s[2] + limits.deadline_us, "PAUSED", "deadline"), (s[3] + limits.stall_us, "TRIPWIRE", "stall"))


def advance(s: list | None, us: int, bad: bool, seconds: float, signal: str | None, limits: Limits) -> tuple[list, list[tuple]]:
    """State and new transitions (attempt, state, us, reason) after a row.  signal: done, failed, resume or null."""
    out = []
    if s is not None and s[0] == "RUNNING" and us >= (end := due(s, limits))[0]:
        s = [end[1], *s[1:]]
        out.append((s[1], end[1], end[0], end[2]))
    if s is None or s[0] == "PAUSED" and signal == "resume":
        attempt = 1 if s is None else s[1] + 1
        out += [(attempt, "STARTING", us, None), (attempt, "RUNNING", us, None)]
        s = ["RUNNING", attempt, us, us, 0, 0, 0.0]
    if s[0] != "RUNNING":
        return s, out
    s = ["RUNNING", s[1], s[2], us, s[4] + 1, s[5] + bad, s[6] + seconds] if s[4] < limits.first else ["RUNNING", s[1], s[2], us, s[4] + 1, *s[5:]]
    reason, state = None, "TRIPWIRE"
    if s[4] == limits.first:
        reason = "failures" if s[5] > limits.bad_share * limits.first else "slow" if s[6] > limits.times * limits.reference * limits.first else None
    if reason is None and signal in ("done", "failed"):
        reason, state = signal, "COMPLETED" if signal == "done" else "FAILED"
    if reason:
        s = [state, *s[1:]]
        out.append((s[1], state, us, reason))
    return s, out


class Watchdog(StatefulProcessor):
    """Keeps one small state a job; a timer ends jobs that give no more rows."""

    def __init__(self, limits: Limits) -> None:
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", _STATE)

    def _frame(self, key: Any, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            rows = [(int(key[0]), attempt, state, pd.Timestamp(_at(us)), reason) for attempt, state, us, reason in out]
            yield pd.DataFrame(rows, columns=["job", "attempt", "state", "at", "reason"]).astype({"attempt": "int32", "reason": "object"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values(["us", "id"])
        s = list(self.state.get()) if self.state.exists() else None
        out: list[tuple] = []
        for us, bad, seconds, signal in zip(got["us"], got["bad"], got["seconds"], got["signal"], strict=True):
            s, new = advance(s, int(us), bool(bad), float(seconds), signal if isinstance(signal, str) else None, self.limits)
            out += new
        self.state.update(tuple(s))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if s[0] == "RUNNING":
            self.handle.registerTimer(-(-due(s, self.limits)[0] // 1000))
        yield from self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = list(self.state.get()) if self.state.exists() else None
        if s is not None and s[0] == "RUNNING":
            us, state, reason = due(s, self.limits)
            self.state.update((state, *s[1:]))
            yield from self._frame(key, [(s[1], state, us, reason)])

    def close(self) -> None:
        pass


def watch(rows: DataFrame, limits: Limits, delay: str = "0 seconds") -> DataFrame:
    """job, attempt, state, at, reason for a stream of rows: job, id, ts, bad, seconds, signal.

    Needs the RocksDB state store.  delay: how late rows may come; ends that no row
    shows are given when the watermark has passed them.
    """
    keyed = rows.withWatermark("ts", delay).select("job", "id", "ts", F.unix_micros("ts").alias("us"), "bad", "seconds", "signal")
    return keyed.groupBy("job").transformWithStateInPandas(Watchdog(limits), StructType.fromDDL(STATES), "Append", "EventTime")


def run_states(rows: DataFrame, limits: Limits, now: datetime | None = None) -> DataFrame:
    """The same states over a whole table by windows, for jobs of one attempt; what comes after the first end is passed over.

    now: the time up to which jobs without further rows are judged; null: they go on running.
    """
    order = Window.partitionBy("job").orderBy("us", "id")
    r = rows.select("job", "id", F.unix_micros("ts").alias("us"), F.col("bad").cast("int").alias("bad"), "seconds", "signal")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = r.withColumn("n", F.row_number().over(order)).withColumn("last", F.lag("us").over(order)).withColumn("first", F.min("us").over(order))
    r = r.withColumn("bads", F.sum("bad").over(so_far)).withColumn("total", F.sum("seconds").over(so_far))
    cut = F.col("us") >= F.least(F.col("first") + limits.deadline_us, F.col("last") + limits.stall_us)
    ending = lambda last: F.least(F.struct((F.col("first") + limits.deadline_us).alias("us"), F.lit("PAUSED").alias("state"), F.lit("deadline").alias("reason")), F.struct((last + limits.stall_us).alias("us"), F.lit("TRIPWIRE").alias("state"), F.lit("stall").alias("reason")))
    here = lambda state, reason: F.struct(F.col("us"), F.lit(state).alias("state"), F.lit(reason).alias("reason"))
    judged = F.col("n") == limits.first
    own = F.when(judged & (F.col("bads") > limits.bad_share * limits.first), here("TRIPWIRE", "failures")).when(judged & (F.col("total") > limits.times * limits.reference * limits.first), here("TRIPWIRE", "slow")).when(F.col("signal") == "done", here("COMPLETED", "done")).when(F.col("signal") == "failed", here("FAILED", "failed"))
    ends = r.select("job", "n", F.when((F.col("n") > 1) & cut, ending(F.col("last"))).otherwise(own).alias("end"))
    found = ends.filter("end is not null").groupBy("job").agg(F.min_by("end", "n").alias("end"))
    if now is not None:
        quiet = r.groupBy("job").agg(F.min("us").alias("first"), F.max("us").alias("us")).select("job", ending(F.col("us")).alias("late"))
        found = quiet.join(found, "job", "left").select("job", F.coalesce("end", F.when(F.col("late.us") <= int(now.replace(tzinfo=timezone.utc).timestamp() * 10**6), F.col("late"))).alias("end")).filter("end is not null")
    starts = r.groupBy("job").agg(F.min("us").alias("us")).select("job", F.explode(F.array(F.struct("us", F.lit("STARTING").alias("state"), F.lit(None).cast("string").alias("reason")), F.struct("us", F.lit("RUNNING").alias("state"), F.lit(None).cast("string").alias("reason")))).alias("end"))
    return starts.unionByName(found).select("job", F.lit(1).alias("attempt"), "end.state", F.timestamp_micros("end.us").alias("at"), "end.reason")


def bad_transitions(states: DataFrame) -> DataFrame:
    """job, no, last, state of states that may not follow the one before (columns job, no, state; no numbers a job's states)."""
    last = F.lag("state").over(Window.partitionBy("job").orderBy("no"))
    allowed = [(a or "") + ">" + b for a, follow in FOLLOWS.items() for b in sorted(follow)]
    return states.withColumn("last", last).filter(~F.concat_ws(">", F.coalesce("last", F.lit("")), "state").isin(allowed)).select("job", "no", "last", "state")
