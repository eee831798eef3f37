"""Queries that run a stream over the tables to its end."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.backtests import MACHINE, dipping_equity
from tidemark.plans.registry import query
from tidemark.plans.sql import div, r, sql
from tidemark.session import new_path, stored
from tidemark.sources import bars
from tidemark.streaming import jobs

LTZ = lambda c="ts": F.col(c).cast("timestamp")


def stream(spark, df, by=None):
    """A stream of a derived table's rows, through Parquet in the shared folder: in one batch, or in a batch for each value of
    by, in its order."""
    path = new_path(spark, "source")
    df = df.withColumn("ts", LTZ())
    reader = spark.readStream.schema(df.schema)
    if by is None:
        df.write.parquet(path)
        return reader.parquet(path)
    rows = stored(df.withColumn("_by", by))
    for value in [r[0] for r in rows.select("_by").distinct().orderBy("_by").collect()]:
        rows.where(F.col("_by") == value).drop("_by").coalesce(1).write.mode("append").parquet(path)
    return reader.option("maxFilesPerTrigger", 1).parquet(path)


def five_days():
    """A value for every five days, so that a month is a handful of batches."""
    return F.floor(F.datediff(F.col("ts"), F.lit("2000-01-01")) / 5)


def ticks(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return spark.readStream.schema(e.schema).parquet(f"{d}/events.parquet*").select("event_id", LTZ().alias("ts"), F.col("event_type").alias("symbol"), "value")


@query(
    sql(f"""SELECT symbol, time_bucket(INTERVAL '60 minutes', ts) AS window_start, max(ts) AS ts, {r('arg_max(value, ts)', 'bid')},
        {r('arg_max(value, ts) + 1', 'ask')}, count(*) AS updates FROM (SELECT event_type AS symbol, ts, value FROM events)
    GROUP BY 1, 2 HAVING time_bucket(INTERVAL '60 minutes', max(ts)) + INTERVAL '60 minutes' <= (SELECT max(ts) - INTERVAL '2 minutes' FROM events)""")
)
def stream_latest_books(spark, d):
    """Latest tick of each symbol in every closed window."""
    t = ticks(spark, d).select("symbol", "ts", F.col("value").alias("bid"), (F.col("value") + 1).alias("ask"))
    out = jobs.drain(jobs.latest_books(t, "60 minutes"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "ts")})


FIRST_PRICES = """SELECT symbol, "interval", ts, open, high, low, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol, "interval", ts
    ORDER BY arrival) AS rn
    FROM candles_raw WHERE NOT (close <= 0 OR high < low OR volume < 0)) WHERE rn = 1"""


@query(sql(FIRST_PRICES.replace("ts, open, high, low, close, volume FROM", "ts FROM", 1)))
def stream_candle_ingest(spark, d):
    """Valid candles, each key once."""
    s = stream(spark, bars.damaged(bars.candles(spark, d)).select("symbol", "interval", "ts", "open", "high", "low", "close", "volume"))
    return jobs.drain(jobs.fresh_candles(s, "60 days")).select("symbol", "interval", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(sql(FIRST_PRICES))
def stream_candle_store(spark, d):
    """Candles taken into a store by a stream that is stopped and restarted; its second part brings all of the first again,
    with other prices for some. Each key stays once, with its first prices."""
    names = ["symbol", "interval", "ts", "open", "high", "low", "close", "volume"]
    rows = stored(bars.damaged(bars.candles(spark, d)).select(*names, "arrival").withColumn("ts", LTZ()))
    source, path, checkpoint = new_path(spark, "source"), new_path(spark, "store"), new_path(spark, "checkpoint")
    for part in (rows.where("arrival = 0"), rows.orderBy("arrival")):
        part.write.mode("append").parquet(source)
        incoming = spark.readStream.schema(rows.schema).parquet(source)
        jobs.ingest(incoming, path, checkpoint, "candles", arrival="arrival").awaitTermination()
    back = spark.read.parquet(path).withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "interval": F.col("interval").cast("string")})
    return back.select(*names)


@query(
    sql(f"""SELECT p.symbol, p.ts, p.direction, {r('p.magnitude', 'magnitude')}, {r(div('n.close - c.close', 'c.close'), 'actual_magnitude')}, n.ts AS scored_at
        FROM predictions p JOIN candles_60 c ON p.symbol = c.symbol AND p.ts = c.ts JOIN candles_60 n ON n.symbol = p.symbol
        AND n.ts = p.ts + INTERVAL '60 minutes'""")
)
def stream_outcomes(spark, d):
    """Predictions scored by the next candle as it comes."""
    p = stream(spark, bars.predictions(spark, d).select("symbol", "ts", "direction", "magnitude"))
    c = stream(spark, bars.candles(spark, d).select("symbol", "ts", "close"))
    out = jobs.drain(jobs.scored_outcomes(p, c))
    return out.withColumns({x: F.col(x).cast("timestamp_ntz") for x in ("ts", "scored_at")})


@query(
    sql(f"""SELECT symbol, w.ts, {r('sum(volume)', 'volume_24h')} FROM candles_60 c CROSS JOIN LATERAL (SELECT unnest(generate_series(c.ts + INTERVAL '1 hour',
        c.ts + INTERVAL '24 hours', INTERVAL '1 hour')) AS ts) w
    WHERE w.ts <= (SELECT max(ts) - INTERVAL '2 hours' FROM candles_60) GROUP BY 1, 2""")
)
def stream_volume_24h(spark, d):
    s = stream(spark, bars.candles(spark, d).select("symbol", "ts", "volume"))
    return jobs.drain(jobs.volume_24h(s)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# Each batch's history is the 500 directions kept before it and its own; the first history of 30 or more is the baseline.
_DRIFT = """WITH x AS (SELECT "interval", ts, direction, floor(date_diff('day', DATE '2000-01-01', CAST(ts AS DATE)) / 5) AS b, row_number()
    OVER (PARTITION BY "interval" ORDER BY ts, symbol) AS i FROM predictions),
  g AS (SELECT "interval", b, max(ts) AS last_ts, max(i) AS upto, min(i) - 1 AS before FROM x GROUP BY ALL),
  h AS (SELECT *, upto - before + least(before, 500) AS n, min(CASE WHEN upto >= 30 THEN upto END) OVER (PARTITION BY "interval") AS base FROM g),
  s AS (SELECT h."interval", h.b, any_value(last_ts) AS last_ts, any_value(n) AS n, c.direction, any_value(h.upto >= 30) AS known,
    count(*) FILTER (WHERE x.direction = c.direction AND x.i > upto - least(200, n) AND x.i <= upto) / least(200, any_value(n)) AS p,
    count(*) FILTER (WHERE x.direction = c.direction AND x.i <= base) / any_value(base) AS q
    FROM h JOIN x ON x."interval" = h."interval" CROSS JOIN (VALUES ('UP'), ('FLAT'), ('DOWN')) AS c(direction) GROUP BY h."interval", h.b, c.direction),
  k AS (SELECT "interval", last_ts, n, CASE WHEN any_value(known) THEN sum(pn * ln(pn / qn)) END AS kl FROM (
    SELECT *, greatest(p, 1e-10) / sum(greatest(p, 1e-10)) OVER w AS pn, greatest(q, 1e-10) / sum(greatest(q, 1e-10)) OVER w AS qn
    FROM s WINDOW w AS (PARTITION BY "interval", b)) GROUP BY "interval", b, last_ts, n)"""


@query(sql(f"""{_DRIFT} SELECT "interval", last_ts, n, {r('kl', 'kl')}, coalesce(kl > 0.1, false) AS drifted FROM k"""))
def stream_drift(spark, d):
    """Drift of the newest predictions from the first ones, after each of several batches."""
    s = stream(spark, bars.predictions(spark, d).select("interval", "symbol", "ts", "direction"), five_days())
    return jobs.drain(jobs.drift_monitor(s)).withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))


@query(MACHINE.replace("ts, equity, state", "ts, state"))
def stream_circuit_breaker(spark, d):
    e = dipping_equity(spark, d)
    return jobs.drain(jobs.circuit_breaker(stream(spark, e, five_days()))).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(sql("""SELECT 'events' AS source, max(ts) AS last_ts FROM events"""))
def stream_freshness(spark, d):
    out = jobs.drain(jobs.freshness(ticks(spark, d), "events"), "complete")
    return out.select("source", F.col("last_ts").cast("timestamp_ntz").alias("last_ts"))


# A source's alarm comes in a batch without rows of it, once its limit lies before the watermark, which is the newest time of
# the batches before: of the batch that its next rows come in (or two after the last one), two earlier.
_ALARMS = """WITH x AS (SELECT 'predictions' AS source, ts, 120 AS lim FROM predictions UNION ALL SELECT 'order_book', ts, 20 FROM order_book UNION ALL
    SELECT 'funding', ts, 600 FROM funding UNION ALL SELECT 'fear_greed', ts, 1560 FROM fear_greed),
  b AS (SELECT *, dense_rank() OVER (ORDER BY floor(date_diff('day', DATE '2000-01-01', CAST(ts AS DATE)) / 5)) AS b FROM x),
  m AS (SELECT b, max(max(ts)) OVER (ORDER BY b) AS newest FROM b GROUP BY b),
  g AS (SELECT source, b, max(ts) AS last_ts, any_value(lim) AS lim FROM b GROUP BY source, b),
  n AS (SELECT *, coalesce(lead(b) OVER (PARTITION BY source ORDER BY b), (SELECT max(b) + 2 FROM m)) - 2 AS seen FROM g)
  SELECT source, last_ts, false AS stale FROM n UNION ALL SELECT source, last_ts, true FROM n JOIN m ON m.b = n.seen WHERE n.seen >= n.b
  AND last_ts + to_minutes(lim) <= newest"""


@query(sql(_ALARMS))
def stream_freshness_alarms(spark, d):
    """Newest time of each of four sources after each batch, and an alarm for each source that its limit finds stale."""
    limits = {"predictions": 120.0, "order_book": 20.0, "funding": 600.0, "fear_greed": 1560.0}
    tables = {"predictions": bars.predictions, "order_book": bars.order_book, "funding": bars.funding, "fear_greed": bars.fear_greed}
    rows = [t(spark, d).select(F.lit(name).alias("name"), "ts") for name, t in tables.items()]
    s = stream(spark, reduce(DataFrame.unionByName, rows), five_days())
    alarms = jobs.freshness_alarms({name: s.where(F.col("name") == name) for name in tables}, limits, "event")
    return jobs.drain(alarms, "update").select("source", F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "stale")
