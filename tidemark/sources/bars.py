"""Market tables derived from the event and order tables: candles, side series, predictions, trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(ts: Column | str, minutes: int) -> Column:
    """Start of the time bucket; stays without time zone."""
    return F.window(ts, f"{minutes} minutes")["start"].alias("ts")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def ohlcv(ticks: DataFrame, key: list[str], price: str, volume: str, order: str = "at") -> DataFrame:
    """Candles of ticks that carry the bucket `ts`: one aggregate, partial before the shuffle."""
    return ticks.groupBy(*key, "ts").agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum(volume).alias("volume")
    )


def candles(spark: SparkSession, sf_dir: str, minutes: int = 60) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").alias("at"), bucket("ts", minutes), "value")
    return ohlcv(e, ["symbol"], "value", "value").withColumn("interval", F.lit(str(minutes)))


def user_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day bars of many symbols."""
    e = read(spark, sf_dir, "events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"), F.col("ts").alias("at"), bucket("ts", 1440), "value")
    return ohlcv(e, ["symbol"], "value", "value").withColumn("interval", F.lit("1440"))


def damaged(bars: DataFrame) -> DataFrame:
    """The candles with every 97th close negated, every 89th high and low swapped, every 83rd volume negated, and every
    71st row repeated with another close; arrival says which came first."""
    from tidemark.functions.chunks import numbered

    n = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))  # a row a symbol
    n = n.select("symbol", F.coalesce(F.sum("_n").over(Window.orderBy("symbol").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    r = numbered(bars, "r", key=("symbol",)).join(n, "symbol").withColumn("r", F.col("r") + F.col("_before") + 1).drop("_before")
    r = r.withColumns({"close": F.when(F.col("r") % 97 == 0, -F.col("close")).otherwise(F.col("close")), "volume": F.when(F.col("r") % 83 == 0, -F.col("volume")).otherwise(F.col("volume")), "_h": F.when(F.col("r") % 89 == 0, F.col("low")).otherwise(F.col("high")), "_l": F.when(F.col("r") % 89 == 0, F.col("high")).otherwise(F.col("low"))})
    r = r.drop("high", "low").withColumnsRenamed({"_h": "high", "_l": "low"}).withColumn("arrival", F.lit(0))
    again = r.where("r % 71 = 0").withColumns({"close": F.col("close") + 1, "arrival": F.lit(1)})
    return r.unionByName(again)


def predictions(spark: SparkSession, sf_dir: str, minutes: int = 60) -> DataFrame:
    """One prediction per candle, from the last event in it."""
    e = events(spark, sf_dir).select(F.col("event_type").alias("symbol"), F.col("ts").alias("at"), bucket("ts", minutes), "k")
    last = e.groupBy("symbol", "ts").agg(F.max_by("k", "at").alias("k"))
    return with_probabilities(last).withColumn("interval", F.lit(str(minutes)))


def with_probabilities(df: DataFrame) -> DataFrame:
    up = 0.6 * (F.col("k") + 0.5) / 100
    df = df.withColumns({"prob_up": up, "prob_flat": F.lit(0.4), "prob_down": 0.6 - up, "magnitude": (F.col("k") - 49.5) / 1000})
    from tidemark.functions.columns import argmax3

    return df.withColumn("direction", argmax3("prob_up", "prob_flat", "prob_down"))


def model_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predictions of three models."""
    p = predictions(spark, sf_dir).select("symbol", "interval", "ts", "k")
    m = p.withColumn("m", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("k", (F.col("k") * 7 + 13 * F.col("m")) % 100)
    return with_probabilities(m).withColumn("model", F.concat(F.lit("m"), F.col("m").cast("string"))).drop("m")


def order_book(spark: SparkSession, sf_dir: str, levels: int = 15) -> DataFrame:
    """Per hour: bid volumes from even events, ask volumes from odd ones, in order; books with an empty side dropped."""
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").alias("at"), bucket("ts", 60), "event_id", "value")
    side = lambda odd: F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("event_id") % 2 == odd, F.struct("at", "value")))), lambda x: x["value"]), 1, levels)
    return e.groupBy("symbol", "ts").agg(side(0).alias("bid_vols"), side(1).alias("ask_vols")).where("size(bid_vols) > 0 and size(ask_vols) > 0")


def funding(spark: SparkSession, sf_dir: str, hours: int = 8) -> DataFrame:
    e = events(spark, sf_dir).select(F.col("event_type").alias("symbol"), bucket("ts", 60 * hours), "k", "value")
    return e.groupBy("symbol", "ts").agg(((F.avg("k") - 49.5) / 50000).alias("funding_rate"), (F.max("value") + 1).alias("mark_price"), (F.min("value") + 1).alias("last_price"))


def derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open interest, liquidations and long/short ratio per hour."""
    e = events(spark, sf_dir).select(F.col("event_type").alias("symbol"), bucket("ts", 60), "k", "value")
    low = F.col("k") < 50
    return e.groupBy("symbol", "ts").agg(
        F.sum("k").cast("double").alias("oi_close"),
        F.coalesce(F.sum(F.when(low, F.col("value"))), F.lit(0.0)).alias("long_vol"),
        F.coalesce(F.sum(F.when(~low, F.col("value"))), F.lit(0.0)).alias("short_vol"),
        ((1 + F.count_if(low)) / (1 + F.count_if(~low))).alias("ratio"),
    )


def fear_greed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(bucket("ts", 1440), "k").groupBy("ts").agg(F.avg("k").alias("value"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.concat(F.lit("U"), (F.col("user_id") % 20).cast("string")).alias("symbol"), bucket("ts", 60), "event_type")
    n = lambda t: F.count_if(F.col("event_type") == t)
    return e.groupBy("symbol", "ts").agg(n("purchase").alias("positive"), n("error").alias("negative"), n("view").alias("neutral")).withColumn("total", F.col("positive") + F.col("negative") + F.col("neutral"))


def trades(spark: SparkSession, sf_dir: str, cost: float = 0.0022) -> DataFrame:
    """Closed trades: order lines with their order's date as entry and their ship date as exit."""
    t = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate >= o_orderdate")
    n = F.col("l_extendedprice")
    return t.select(
        F.col("o_orderdate").alias("entry"), F.col("l_shipdate").alias("exit"), F.when(F.col("l_linestatus") == "O", "LONG").otherwise("SHORT").alias("side"), n.alias("notional"),
        (n * (F.col("l_discount") - F.col("l_tax"))).alias("net_pnl"), (n * cost).alias("costs"),
    )


def equity(spark: SparkSession, sf_dir: str, capital: float = 1e9) -> DataFrame:
    """Equity per exit day; the running sum is over one row a day."""
    days = trades(spark, sf_dir).groupBy(F.col("exit").alias("ts")).agg(F.sum("net_pnl").alias("pnl"))
    return days.withColumn("equity", capital + F.sum("pnl").over(Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)))
