"""Streams over several batches: restarts, replays, state and timers."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.session import new_path
from tidemark.sources import store
from tidemark.streaming import jobs

T0 = dt.datetime(2025, 1, 1)
BARS = "symbol string, interval string, ts timestamp, open double, high double, low double, close double, volume double, arrival int"


def candles(spark, rows):
    return spark.createDataFrame([(s, "60", T0 + dt.timedelta(hours=h), c, c, c, c, 1.0, a) for s, h, c, a in rows], BARS)


def in_batches(spark, parts):
    """A stream with a batch for each frame."""
    path = new_path(spark, "source")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(path), path


def test_ingest_survives_restarts_and_replays(spark):
    first = candles(spark, [("A", 0, 1.0, 0), ("A", 1, 2.0, 0), ("B", 0, 3.0, 0), ("B", 1, -1.0, 0)])
    second = candles(spark, [("A", 1, 9.0, 1), ("A", 2, 4.0, 2), ("A", 2, 8.0, 3), ("B", 1, 5.0, 1), ("B", 1, 6.0, 2)])
    stream, source = in_batches(spark, [first])
    path, checkpoint = new_path(spark, "store"), new_path(spark, "checkpoint")
    jobs.ingest(stream, path, checkpoint, "candles", arrival="arrival").awaitTermination()
    want = {("A", 0): 1.0, ("A", 1): 2.0, ("B", 0): 3.0}
    stored = lambda: {(r.symbol, r.ts.hour): r.close for r in spark.read.parquet(path).collect()}
    assert stored() == want and spark.read.parquet(path).count() == 3
    jobs.ingest(stream, path, checkpoint, "candles", arrival="arrival").awaitTermination()
    assert [r.batch_id for r in store.batches_done(spark, path).collect()] == [0], "nothing new, no batch"
    second.coalesce(1).write.mode("append").parquet(source)
    jobs.ingest(stream, path, checkpoint, "candles", arrival="arrival").awaitTermination()
    want |= {("A", 2): 4.0, ("B", 1): 5.0}
    assert stored() == want and spark.read.parquet(path).count() == 5
    key = ["symbol", "interval", "ts"]
    assert store.take_batch(candles(spark, [("C", 0, 7.0, 0)]), 1, path, key, ["interval"], "candles") == 0, "a replay"
    # a batch that was written, but whose entry was lost, finds its keys stored
    assert store.take_batch(second.where("close > 0"), 2, path, key, ["interval"], "candles", "arrival") == 0
    assert store.take_batch(candles(spark, [("C", 0, 7.0, 0)]), 1, path, key, ["interval"], "another stream") == 1
    # a new checkpoint reads all over again; batch 0 is in the ledger, and the rest is stored
    jobs.ingest(stream, path, new_path(spark, "checkpoint"), "candles again", arrival="arrival").awaitTermination()
    assert stored() == want | {("C", 0): 7.0} and spark.read.parquet(path).count() == 6
    assert sorted((r.stream, r.batch_id, r.rows) for r in store.batches_done(spark, path).collect()) == [("another stream", 1, 1), ("candles", 0, 3), ("candles", 1, 2), ("candles", 2, 0), ("candles again", 0, 0), ("candles again", 1, 0)]


def test_stored_keys_are_read_from_touched_partitions_only(spark, monkeypatch):
    path = new_path(spark, "store")
    rows = spark.range(40).select((F.col("id") % 4).cast("string").alias("interval"), F.col("id").alias("ts"))
    assert store.append_new(rows, path, ["interval", "ts"], ["interval"]) == 40
    target = spark.read.parquet(path).withColumn("interval", F.col("interval").cast("string"))
    batch = rows.where("interval = '2'")
    plan = store._touched(target, batch, ["interval"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(cast(interval" in plan or "PartitionFilters: [isnotnull(interval" in plan, plan
    assert store._touched(target, batch, ["interval"]).count() == 10
    monkeypatch.setattr(store, "MOST_PARTITIONS", 0)
    assert store._touched(target, batch, ["interval"]).count() == 10
    assert store.append_new(batch, path, ["interval", "ts"], ["interval"]) == 0
    nulls = rows.withColumn("interval", F.lit(None).cast("string")).limit(3)
    monkeypatch.undo()
    assert store.append_new(nulls, path, ["ts"], ["interval"]) == 3 and store.append_new(nulls, path, ["ts"], ["interval"]) == 0


def directions(spark, start, text):
    names = {"U": "UP", "F": "FLAT", "D": "DOWN"}
    return spark.createDataFrame([("60", "A", T0 + dt.timedelta(hours=start + i), names[c]) for i, c in enumerate(text)], "interval string, symbol string, ts timestamp, direction string")


def test_drift_baseline_is_all_there_is_when_it_is_set(spark):
    parts = ["UF" * 10, "D" * 20 + "U" * 5, "D" * 10, "U" * 300]
    at, frames = 0, []
    for p in parts:
        frames.append(directions(spark, at, p))
        at += len(p)
    stream, _ = in_batches(spark, frames)
    got = jobs.drain(jobs.drift_monitor(stream, keep=50, recent=40, least=30)).orderBy("last_ts").collect()
    assert [r.n for r in got] == [20, 45, 55, 350], "what was kept, and the batch's own"
    history, base = "", None
    for r, p in zip(got, parts, strict=True):
        history = history[-50:] + p
        if len(history) < 30:
            assert r.kl is None and not r.drifted
            continue
        shares = lambda t: [max(t.count(c) / len(t), 1e-10) for c in "UFD"]
        base = base or shares(history)
        now = shares(history[-40:])
        want = sum(a / sum(now) * math.log(a / sum(now) / (b / sum(base))) for a, b in zip(now, base, strict=True))
        assert r.kl == pytest.approx(want) and r.drifted == (want > 0.1)
    assert got[1].kl > 0 and got[3].drifted


def test_breaker_keeps_its_state_over_batches(spark):
    from tidemark.operators.risk import drawdown_states

    curve = [100, 96, 94, 89, 88, 93, 94, 95, 80, 99, 101, 95, 96, 120]
    rows = [("p", T0 + dt.timedelta(hours=i), float(v)) for i, v in enumerate(curve)] + [("q", T0, 5.0), ("q", T0 + dt.timedelta(hours=9), 4.0)]
    frame = spark.createDataFrame(rows, "portfolio string, ts timestamp, equity double")
    cut = lambda a, b: frame.where((F.hour("ts") >= a) & (F.hour("ts") < b))
    stream, _ = in_batches(spark, [cut(0, 3), cut(3, 4), cut(4, 9), cut(9, 24)])
    got = jobs.drain(jobs.circuit_breaker(stream)).select("portfolio", "ts", "state", "drawdown", "multiplier")
    want = drawdown_states(frame).select("portfolio", "ts", "state", "drawdown", "multiplier")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_keys_of_a_bucket_keep_states_of_their_own(spark):
    from tidemark.operators.risk import drawdown_states

    curve = lambda k, i: 100.0 + k - (i * (7 * k % 23) % 31)
    rows = [(f"p{k}" if k else None, T0 + dt.timedelta(days=i), curve(k, i)) for k in range(40) for i in range(12) if k % 3 or i > 5]
    frame = spark.createDataFrame(rows, "portfolio string, ts timestamp, equity double")
    stream, _ = in_batches(spark, [frame.where(F.col("ts").between(T0 + dt.timedelta(days=a), T0 + dt.timedelta(days=a + 3))) for a in (0, 4, 8)])
    cols = ["portfolio", "ts", "state", "drawdown", "multiplier"]
    got = jobs.drain(jobs.circuit_breaker(stream, buckets=3)).select(cols).collect()
    want = drawdown_states(frame).select(cols).collect()
    key = lambda r: (r[0] is None, r[0] or "", r[1])
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key) and len({r.state for r in got}) > 2


def test_stale_sources_by_event_time(spark):
    minute = lambda name, *ms: [(name, T0 + dt.timedelta(minutes=m)) for m in ms]
    frame = lambda *rows: spark.createDataFrame([r for part in rows for r in part], "name string, ts timestamp")
    parts = [frame(minute("a", 0, 5), minute("b", 3)), frame(minute("a", 30, 20)), frame(minute("a", 40)), frame(minute("a", 50), minute("b", 49)), frame(minute("a", 55))]
    stream, _ = in_batches(spark, parts)
    split = {n: stream.where(F.col("name") == n) for n in "ab"}
    got = jobs.drain(jobs.freshness_alarms(split, {"a": 60, "b": 20}, "event"), "update").collect()
    assert sorted((r.batch_id, r.source, (r.last_ts - T0).seconds // 60, r.stale) for r in got) == [
        (0, "a", 5, False), (0, "b", 3, False), (1, "a", 30, False), (2, "a", 40, False), (2, "b", 3, True), (3, "a", 50, False), (3, "b", 49, False), (4, "a", 55, False),
    ]
    with pytest.raises(ValueError):
        jobs.freshness_alarms(split, {"a": 1})


def test_stale_sources_by_the_clock(spark):
    import time

    frame = spark.createDataFrame([("a", T0), ("b", T0)], "name string, ts timestamp")
    stream, path = in_batches(spark, [frame])
    split = {n: stream.where(F.col("name") == n) for n in "ab"}
    seen = []
    with jobs.typed_state(spark):
        alarms = jobs.freshness_alarms(split, {"a": 0.05, "b": 600}, "processing").writeStream.outputMode("update").trigger(processingTime="1 second")
        query = alarms.foreachBatch(lambda batch, i: seen.extend(map(tuple, batch.collect()))).option("checkpointLocation", new_path(spark, "checkpoint")).start()
    try:
        for _ in range(60):
            time.sleep(1)
            if any(stale for _, _, stale in seen):
                break
    finally:
        query.stop()
    assert sorted(seen) == [("a", T0, False), ("a", T0, True), ("b", T0, False)]
