"""Run states and replayed logs over events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..derive import Tables
from ..sources.shared import shared_path
from ..streaming import watchdog as W
from ..streaming.resume import replay_check
from .base import query

HOUR = 3600 * 10**6
LIMITS = W.Limits(stall_us=6 * HOUR, deadline_us=30 * HOUR, first=20, bad_share=0.3, reference=20.0, times=2.0)

_RUNS = f""", r AS (SELECT user_id AS job, event_id AS id, epoch_us(ts) AS us, CAST(event_type = 'error' AS INTEGER) AS bad, value AS seconds,
  CASE props WHEN '{{"k": 99}}' THEN 'done' WHEN '{{"k": 98}}' THEN 'failed' END AS signal FROM events),
w AS (SELECT *, row_number() OVER o AS n, lag(us) OVER o AS last, min(us) OVER (PARTITION BY job) AS first, max(us) OVER (PARTITION BY job) AS final, sum(bad) OVER o AS bads, sum(seconds) OVER o AS total,
  (SELECT max(epoch_us(ts)) FROM events) AS now FROM r WINDOW o AS (PARTITION BY job ORDER BY us, id ROWS UNBOUNDED PRECEDING)),
e AS (SELECT job, n, CASE WHEN n > 1 AND us >= least(first + {LIMITS.deadline_us}, last + {LIMITS.stall_us})
    THEN CASE WHEN first + {LIMITS.deadline_us} <= last + {LIMITS.stall_us} THEN {{'us': first + {LIMITS.deadline_us}, 'state': 'PAUSED', 'reason': 'deadline'}} ELSE {{'us': last + {LIMITS.stall_us}, 'state': 'TRIPWIRE', 'reason': 'stall'}} END
  WHEN n = {LIMITS.first} AND bads > {LIMITS.bad_share * LIMITS.first} THEN {{'us': us, 'state': 'TRIPWIRE', 'reason': 'failures'}}
  WHEN n = {LIMITS.first} AND total > {LIMITS.times * LIMITS.reference * LIMITS.first} THEN {{'us': us, 'state': 'TRIPWIRE', 'reason': 'slow'}}
  WHEN signal = 'done' THEN {{'us': us, 'state': 'COMPLETED', 'reason': 'done'}} WHEN signal = 'failed' THEN {{'us': us, 'state': 'FAILED', 'reason': 'failed'}} END AS ended FROM w),
q AS (SELECT DISTINCT job, first, CASE WHEN least(first + {LIMITS.deadline_us}, final + {LIMITS.stall_us}) <= now
  THEN CASE WHEN first + {LIMITS.deadline_us} <= final + {LIMITS.stall_us} THEN {{'us': first + {LIMITS.deadline_us}, 'state': 'PAUSED', 'reason': 'deadline'}} ELSE {{'us': final + {LIMITS.stall_us}, 'state': 'TRIPWIRE', 'reason': 'stall'}} END END AS quiet FROM w),
a AS (SELECT job, first, coalesce((SELECT arg_min(ended, n) FROM e WHERE e.job = q.job AND ended IS NOT NULL), quiet) AS x FROM q),
s AS (SELECT job, unnest([{{'us': first, 'state': 'STARTING', 'reason': NULL}}, {{'us': first, 'state': 'RUNNING', 'reason': NULL}}, x]) AS x FROM a)
SELECT job, CAST(1 AS INTEGER) AS attempt, x.state AS state, make_timestamp(x.us) AS at, x.reason AS reason FROM s WHERE x IS NOT NULL"""


def _rows(events: DataFrame) -> DataFrame:
    signal = F.when(F.col("props") == '{"k": 99}', "done").when(F.col("props") == '{"k": 98}', "failed")
    return events.select(F.col("user_id").alias("job"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("bad"), F.col("value").alias("seconds"), signal.alias("signal"))


@query(_RUNS)
def run_states(t: Tables) -> DataFrame:
    """States of every user's run of events, by windows."""
    rows = _rows(t.read("events"))
    return W.run_states(rows, LIMITS, rows.agg(F.max("ts")).first()[0])


@query(_RUNS)
def run_states_stream(t: Tables) -> DataFrame:
    """The same states from the events replayed as a stream, with timers."""
    spark = t.spark
    folder = f"{shared_path(spark)}/graphloom-stream-{uuid.uuid4().hex}"
    conf, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(conf)
    spark.conf.set(conf, store)
    try:
        path = f"{t.dir}/events.parquet"
        stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{t.dir}/events.parque[t]")  # a file or a folder
        W.watch(_rows(stream), LIMITS).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/mark").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(conf, before)
    return spark.read.schema(W.STATES).parquet(f"{folder}/out")


@query(""", l AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no, {'event': event_type, 'value': value} AS x FROM events WHERE event_id % 10 < 7),
r AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no, {'event': event_type, 'value': value} AS x FROM events WHERE event_id % 10 < 7 OR event_type = 'error'),
b AS (SELECT coalesce(l.run, r.run) AS run, coalesce(l.no, r.no) AS no, l.x AS l, r.x AS r FROM l FULL JOIN r ON l.run = r.run AND l.no = r.no)
SELECT run, count(l) AS n_logged, count(r) AS n_replayed, CAST(min(no) FILTER (WHERE l IS NOT NULL AND (r IS NULL OR l <> r)) AS INTEGER) AS first_difference FROM b GROUP BY run""")
def replayed_logs(t: Tables) -> DataFrame:
    """Where the log of a user's events differs from a replay that also writes down late errors."""
    e = t.read("events").select("user_id", "event_id", "ts", F.col("event_type").alias("event"), "value")
    first = F.col("event_id") % 10 < 7
    return replay_check(e.filter(first), e.filter(first | (F.col("event") == "error")), "user_id", ["ts", "event_id"], ["event", "value"])
