"""Continuous jobs as Structured Streaming queries. Streams need TIMESTAMP, so NTZ columns are cast on the way in."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.session import new_path


def latest_books(books: DataFrame, every: str = "60 seconds", late: str = "2 minutes") -> DataFrame:
    """The latest book of each symbol in every tumbling window."""
    w = books.withWatermark("ts", late).groupBy(F.window("ts", every), "symbol")
    return w.agg(F.max_by(F.struct("ts", "bid", "ask"), "ts").alias("b"), F.count(F.lit(1)).alias("updates")).select("symbol", F.col("window.start").alias("window_start"), "b.*", "updates")


def fresh_candles(bars: DataFrame, late: str = "48 hours") -> DataFrame:
    """Valid candles, each key once within the watermark."""
    from tidemark.operators.quality import valid

    return valid(bars.withWatermark("ts", late)).dropDuplicatesWithinWatermark(["symbol", "interval", "ts"])


def volume_24h(bars: DataFrame, late: str = "2 hours") -> DataFrame:
    """Sliding day volume, every hour."""
    return bars.withWatermark("ts", late).groupBy(F.window("ts", "24 hours", "1 hour"), "symbol").agg(F.sum("volume").alias("volume_24h")).select("symbol", F.col("window.end").alias("ts"), "volume_24h")


def scored_outcomes(predictions: DataFrame, bars: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """Predictions with the candle at their time and the next one, as soon as both are there: two inner joins whose time
    bounds let the state go. A next candle after a gap is left to the batch job."""
    p = predictions.withWatermark("ts", late)
    a = bars.withWatermark("ts", late).select(F.col("symbol").alias("a_symbol"), F.col("ts").alias("a_ts"), F.col("close").alias("base"))
    b = bars.withWatermark("ts", late).select(F.col("symbol").alias("b_symbol"), F.col("ts").alias("b_ts"), F.col("close").alias("next"))
    d = p.join(a, F.expr("symbol = a_symbol AND ts = a_ts"))
    d = d.join(b, F.expr(f"symbol = b_symbol AND b_ts > ts AND b_ts <= ts + interval {minutes} minutes"))
    return d.select("symbol", "ts", "direction", "magnitude", F.try_divide(F.col("next") - F.col("base"), F.col("base")).alias("actual_magnitude"), F.col("b_ts").alias("scored_at"))


def ingest(bars: DataFrame, path: str, checkpoint: str, stream: str, partition_by: list[str] | None = None, arrival: str | None = None, **trigger) -> StreamingQuery:
    """Starts a query that takes valid candles into the keyed Parquet table at path, first prices win. It can be stopped and
    restarted with the same checkpoint, replay batches and overlap what is stored: each key stays once, with its first
    prices. stream names this source in the table's ledger of batches; trigger is trigger()'s, all there is now by default."""
    from tidemark.operators.quality import valid
    from tidemark.sources.store import take_batch

    def take(batch: DataFrame, batch_id: int) -> None:
        take_batch(valid(batch), batch_id, path, ["symbol", "interval", "ts"], partition_by or ["interval"], stream, arrival)

    writer = bars.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


@contextmanager
def typed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that are started within keep their state in RocksDB, which list state and timers need; the session's own
    setting is put back after it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def _in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(by, kind="stable", ignore_index=True)


class Drift(StatefulProcessor):
    """Per key the newest `keep` directions, a list that each batch extends, and the baseline's three class shares.

    The baseline is set once, by the first batch after which there are `least` predictions, from all there are then, that
    batch's own ones included and before any is cut off. Each batch with as many gives the divergence of the newest
    `recent` shares from it; before, kl is null."""

    def __init__(self, keep: int, recent: int, least: int, limit: float):
        self.keep, self.recent, self.least, self.limit = keep, recent, least, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "direction string")
        self.base = handle.getValueState("base", "up double, flat double, down double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = _in_order(rows, ["ts", "symbol"])
        history = [x[0] for x in self.kept.get()] + new["direction"].tolist()
        base, kl = self.base.get() if self.base.exists() else None, None
        if len(history) >= self.least:
            if base is None:
                base = class_shares(history)
                self.base.update(tuple(base))
            kl = divergence(class_shares(history[-self.recent :]), base)
        self.kept.put([(x,) for x in history[-self.keep :]])
        yield pd.DataFrame({"key": [key[0]], "last_ts": [new["ts"].iloc[-1]], "n": [len(history)], "kl": pd.array([kl], dtype="Float64"), "drifted": [kl is not None and kl > self.limit]})

    def close(self) -> None:
        pass


def class_shares(directions: list[str]) -> list[float]:
    return [directions.count(c) / len(directions) for c in ("UP", "FLAT", "DOWN")]


def divergence(p: list[float], q: list[float]) -> float:
    """Kullback-Leibler divergence of p from q, shares of nothing taken as 1e-10."""
    least = lambda x: [max(v, 1e-10) for v in x]
    p, q = least(p), least(q)
    return sum(a / sum(p) * math.log(a / sum(p) * sum(q) / b) for a, b in zip(p, q, strict=True))


def drift_monitor(predictions: DataFrame, key: str = "interval", keep: int = 500, recent: int = 200, least: int = 30, limit: float = 0.1) -> DataFrame:
    """(key, last_ts, n, kl, drifted) per batch of predictions(key, symbol, ts, direction): see Drift. Start it within
    typed_state."""
    run = Drift(keep, recent, least, limit)
    d = predictions.select(F.col(key).cast("string").alias("key"), "symbol", "ts", "direction").groupBy("key")
    out = d.transformWithStateInPandas(run, "key string, last_ts timestamp, n long, kl double, drifted boolean", "append", "none")
    return out.withColumnRenamed("key", key)


class Breaker(StatefulProcessor):
    """The drawdown machines of a bucket of keys, the four values of each as a row of a typed list: state is read and written once
    a bucket and batch, not once a key."""

    def __init__(self, limits: dict):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getListState("now", "key string, state string, peak double, halted_at double, periods long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        from tidemark.operators.risk import Drawdown

        machines, got = {}, []
        for of, *now in self.now.get():
            m = machines[of] = Drawdown(**self.limits)
            m.state, m.peak, m.halted_at, m.periods = now
        new = _in_order(rows, ["ts"])
        for of, equity in zip(new["key"], new["equity"], strict=True):
            of = None if pd.isna(of) else of
            if of not in machines:
                machines[of] = Drawdown(**self.limits)
            got.append(machines[of].update(equity))
        self.now.put([(of, m.state, float(m.peak), float(m.halted_at), int(m.periods)) for of, m in machines.items()])
        yield pd.DataFrame({"key": new["key"], "ts": new["ts"], "state": [g[0] for g in got], "drawdown": [g[1] for g in got], "multiplier": [g[2] for g in got]})

    def close(self) -> None:
        pass


def circuit_breaker(equity: DataFrame, key: str = "portfolio", buckets: int = 1024, **limits) -> DataFrame:
    """The drawdown machine over equity updates as they come, the keys dealt to so many buckets that share a call and a state.
    A bucket's state is rewritten with each batch that has rows of it. buckets, as the key of the state, stays the same for a
    checkpoint's life. Start it within typed_state."""
    d = equity.select(F.col(key).cast("string").alias("key"), "ts", "equity")
    d = d.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket")
    out = d.transformWithStateInPandas(Breaker(limits), "key string, ts timestamp, state string, drawdown double, multiplier double", "append", "none")
    return out.withColumnRenamed("key", key)


#: D4's limits: how old a source's newest row may be, in minutes.
FRESHNESS_LIMITS = {"predictions": 120.0, "accuracy_log": 26 * 60.0, "order_book": 20.0}


class Freshness(StatefulProcessor):
    """The newest time of each source, and a timer at that time plus the source's limit. A row that comes in time moves the
    timer; when it runs out, the source is reported stale, once, and again only after new rows."""

    def __init__(self, limits: dict[str, float], event_time: bool):
        self.limits, self.event_time = {k: int(v * 60_000) for k, v in limits.items()}, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts timestamp, expires long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = max(part["ts"].max() for part in rows)
        before = self.last.get() if self.last.exists() else None
        if before is not None and pd.Timestamp(before[0]) >= newest:
            return
        if before is not None:
            self.handle.deleteTimer(before[1])
        start = int(newest.value // 1_000_000) if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        expires = start + self.limits[key[0]]
        self.handle.registerTimer(expires)
        self.last.update((newest.to_pydatetime(), expires))
        yield pd.DataFrame({"source": [key[0]], "last_ts": [newest], "stale": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"source": [key[0]], "last_ts": [pd.Timestamp(self.last.get()[0])], "stale": [True]})

    def close(self) -> None:
        pass


def freshness_alarms(sources: dict[str, DataFrame], limits: dict[str, float] = FRESHNESS_LIMITS, clock: str = "processing", late: str = "0 seconds") -> DataFrame:
    """(source, last_ts, stale) in update mode over several streams with ts: a row with stale false when a source's newest
    time moves on, one with stale true when a source has had no newer row for its limit in minutes.

    With clock "processing" the limit runs by the wall clock, so it reports sources that all stand still. With "event" it
    runs by the watermark of all sources together: the ones that go on tell the one that doesn't, and a rerun over the same
    batches gives the same alarms. Start it within typed_state."""
    missing = set(sources) - set(limits)
    if missing:
        raise ValueError(f"no limit for {sorted(missing)}")
    parts = [s.select(F.lit(name).alias("source"), "ts") for name, s in sources.items()]
    d = reduce(DataFrame.unionByName, parts)
    d = d.withWatermark("ts", late) if clock == "event" else d
    mode = {"event": "EventTime", "processing": "ProcessingTime"}[clock]
    return d.groupBy("source").transformWithStateInPandas(Freshness(limits, clock == "event"), "source string, last_ts timestamp, stale boolean", "update", mode)


def freshness(stream: DataFrame, source: str) -> DataFrame:
    """The newest time of a source, updated with every batch."""
    return stream.agg(F.max("ts").alias("last_ts")).withColumn("source", F.lit(source))


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a streaming query over all that is there now, into Parquet in the shared folder (append), a table of its batches
    there, with batch_id (update), or a memory table (complete), and returns what came out."""
    spark: SparkSession = stream.sparkSession
    at = new_path(spark, "stream")
    name = f"drained_{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{at}/state")
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{at}/rows")
    elif mode == "update":
        writer = writer.foreachBatch(lambda batch, i: batch.withColumn("batch_id", F.lit(i).cast("long")).write.mode("append").parquet(f"{at}/rows"))
    else:
        writer = writer.format("memory").queryName(name)
    with typed_state(spark):
        query = writer.start()
    query.awaitTermination()
    if mode == "complete":
        return spark.table(name)
    schema = stream.schema if mode == "append" else stream.schema.add("batch_id", "long")
    return spark.read.schema(schema).parquet(f"{at}/rows")
