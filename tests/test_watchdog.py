"""The watchdog as a stream, resumed in between, against the batch form and a plain loop."""

import random
from datetime import datetime, timedelta

import pytest

from graphloom.streaming import watchdog as W

LIMITS = W.Limits(stall_us=300 * 10**6, deadline_us=4000 * 10**6, first=20, reference=10.0)
SCHEMA = "job long, id long, ts timestamp, bad boolean, seconds double, signal string"
START = datetime(2024, 1, 1)


def jobs():
    r = random.Random(4)
    rows = []
    for job in range(12):
        at = START + timedelta(seconds=r.randrange(100))
        n = r.choice([3, 19, 20, 60, 150])
        for i in range(n):
            at += timedelta(seconds=r.choice([1, 20, 40, 299, 300] if job % 4 == 0 else [1, 5, 60, 60]))
            bad = r.random() < (0.8 if job % 5 == 1 else 0.2)
            signal = {0: "done", 1: "failed"}.get(job % 3) if i == n - 1 else None
            rows.append((job, 1000 * job + i, at, bad, 50.0 if job % 6 == 2 else 5.0, signal))
    return rows


def plain(rows, now):
    out = []
    for job in sorted({r[0] for r in rows}):
        s = None
        for _, _, ts, bad, sec, signal in sorted((r for r in rows if r[0] == job), key=lambda r: (r[2], r[1])):
            s, new = W.advance(s, int((ts - datetime(1970, 1, 1)) / timedelta(microseconds=1)), bad, sec, signal, LIMITS)
            out += [(job, *x) for x in new]
        if s[0] == "RUNNING" and W._at(W.due(s, LIMITS)[0]) <= now:
            end = W.due(s, LIMITS)
            out.append((job, s[1], end[1], end[0], end[2]))
    return sorted((j, a, st, W._at(us), why) for j, a, st, us, why in out) if out else []


def key(r):
    return tuple("" if x is None else x for x in r)


def test_batch_form_equals_a_loop(spark):
    rows = jobs()
    for now in (START, START + timedelta(days=1)):
        got = [tuple(r) for r in W.run_states(spark.createDataFrame(rows, SCHEMA), LIMITS, now).collect()]
        assert sorted(got, key=key) == sorted(plain(rows, now), key=key)
    assert {r[4] for r in plain(rows, now)} >= {None, "failures", "slow", "stall", "done"}


def test_stream_stopped_and_resumed_equals_batch(spark, tmp_path):
    rows = jobs()
    now = START + timedelta(days=1)
    frames = spark.createDataFrame(rows, SCHEMA)
    source, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:

        def run():
            stream = spark.readStream.schema(SCHEMA).parquet(source)
            query = W.watch(stream, LIMITS).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
            assert query.awaitTermination(90)

        middle = START + timedelta(seconds=900)
        frames.filter(frames.ts < middle).coalesce(1).write.mode("append").parquet(source)
        run()
        frames.filter(frames.ts >= middle).coalesce(1).write.mode("append").parquet(source)
        run()
        # A row of another job, a day later, moves the watermark past every end.
        spark.createDataFrame([(99, 0, now, False, 1.0, None)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        run()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = [tuple(r) for r in spark.read.parquet(out).filter("job < 99").collect()]
    assert sorted(got, key=key) == sorted(plain(rows, now), key=key)


def test_resume_after_pause_and_transitions(spark):
    s, out = None, []
    for us, signal in ((0, None), (5000 * 10**6, None), (5001 * 10**6, "resume"), (5002 * 10**6, "done"), (5003 * 10**6, "failed")):
        s, new = W.advance(s, us, False, 1.0, signal, W.Limits(stall_us=10**12, deadline_us=4000 * 10**6))
        out += new
    assert [(a, st) for a, st, *_ in out] == [(1, "STARTING"), (1, "RUNNING"), (1, "PAUSED"), (2, "STARTING"), (2, "RUNNING"), (2, "COMPLETED")]
    states = spark.createDataFrame([(1, i, st) for i, (_, st, *_) in enumerate(out)], "job int, no int, state string")
    assert W.bad_transitions(states).isEmpty()
    wrong = spark.createDataFrame([(1, 0, "RUNNING"), (1, 1, "COMPLETED"), (1, 2, "RUNNING")], "job int, no int, state string")
    assert sorted((r.no, r.state) for r in W.bad_transitions(wrong).collect()) == [(0, "RUNNING"), (2, "RUNNING")]
    with pytest.raises(TypeError):
        W.Limits()
