"""Exchange and sentiment payloads (JSON text) to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _items(raw: DataFrame, schema: str, payload: str = "payload", outer: tuple[str, ...] = ()) -> DataFrame:
    return raw.select(*outer, F.explode(F.from_json(payload, f"struct<data:array<{schema}>>")["data"]).alias("x"))


def number(x: Column, default: float | None = None) -> Column:
    n = x.try_cast("double")
    return n if default is None else F.coalesce(n, F.lit(default))


def klines(raw: DataFrame) -> DataFrame:
    """raw(symbol, interval, payload): candles; items without a readable time or price are left out, volume is 0 by default."""
    d = _items(raw, "struct<time:string,open:string,high:string,low:string,close:string,baseVol:string>", outer=("symbol", "interval"))
    x = d.select("symbol", "interval", F.timestamp_millis(F.col("x.time").try_cast("bigint")).cast("timestamp_ntz").alias("ts"), *[number(F.col(f"x.{c}")).alias(c) for c in ("open", "high", "low", "close")], number(F.col("x.baseVol"), 0.0).alias("volume"))
    return x.dropna(subset=["ts", "open", "high", "low", "close"])


def tickers(raw: DataFrame) -> DataFrame:
    names = {"lastPrice": "last_price", "markPrice": "mark_price", "open": "open_24h", "high": "high_24h", "low": "low_24h", "baseVol": "base_vol", "quoteVol": "quote_vol"}
    d = _items(raw, "struct<symbol:string," + ",".join(f"{n}:string" for n in names) + ">")
    return d.select(F.col("x.symbol").alias("symbol"), *[number(F.col(f"x.{n}"), 0.0).alias(c) for n, c in names.items()]).where("symbol IS NOT NULL")


def depth(raw: DataFrame, levels: int = 15) -> DataFrame:
    """raw(symbol, payload of {ts, bids: [[price, volume], ..], asks}): the top levels of each side with spread, mid price and
    imbalance (0.5 without volume); books with an empty side are dropped. Levels may be pairs or {price, volume}."""
    pairs = F.from_json("payload", "struct<ts:string,bids:array<array<string>>,asks:array<array<string>>>")
    objects = F.from_json("payload", "struct<ts:string,bids:array<struct<price:string,volume:string>>,asks:array<struct<price:string,volume:string>>>")
    d = raw.select("symbol", pairs.alias("p"), objects.alias("o"))

    def side(s: str, i: int, name: str) -> Column:
        a, b = F.transform(F.col(f"p.{s}"), lambda x: number(F.get(x, i))), F.transform(F.col(f"o.{s}"), lambda x: number(x[name]))
        return F.slice(F.filter(F.coalesce(F.when(F.exists(a, lambda v: v.isNotNull()), a), b, F.array().cast("array<double>")), lambda v: v.isNotNull()), 1, levels)

    d = d.select("symbol", F.timestamp_millis(F.coalesce("p.ts", "o.ts").try_cast("bigint")).cast("timestamp_ntz").alias("ts"), *[side(s, i, n).alias(f"{s[:-1]}_{c}") for s in ("bids", "asks") for i, n, c in ((0, "price", "prices"), (1, "volume", "vols"))])
    d = d.where("size(bid_prices) > 0 AND size(ask_prices) > 0")
    b, a = (F.aggregate(f"{s}_vols", F.lit(0.0), lambda x, y: x + y) for s in ("bid", "ask"))
    bid, ask = F.get("bid_prices", 0), F.get("ask_prices", 0)
    return d.withColumns({"spread": ask - bid, "mid_price": (ask + bid) / 2, "imbalance": F.coalesce(F.try_divide(b, b + a), F.lit(0.5))})


def funding(raw: DataFrame) -> DataFrame:
    d = _items(raw, "struct<symbol:string,ts:string,fundingRate:string,markPrice:string,lastPrice:string,nextFundingTime:string,fundingInterval:string>")
    x = F.col("x")
    return d.select(x["symbol"].alias("symbol"), F.timestamp_millis(x["ts"].try_cast("bigint")).cast("timestamp_ntz").alias("ts"), number(x["fundingRate"], 0.0).alias("funding_rate"), number(x["markPrice"], 0.0).alias("mark_price"), number(x["lastPrice"], 0.0).alias("last_price"), F.timestamp_millis(x["nextFundingTime"].try_cast("bigint")).cast("timestamp_ntz").alias("next_funding_ts"), F.coalesce(x["fundingInterval"].try_cast("int"), F.lit(8)).alias("funding_interval_hours"))


def history(raw: DataFrame, names: DataFrame, fields: dict[str, str]) -> DataFrame:
    """raw(payload of [{symbol, history: [{t, ..}]}]) exploded twice; symbols translated by names(market, symbol), others
    left out; fields maps the payload's names to columns."""
    kind = f"array<struct<symbol:string,history:array<struct<t:bigint,{','.join(f'{k}:double' for k in fields)}>>>>"
    d = raw.select(F.explode(F.from_json("payload", kind)).alias("m")).select(F.col("m.symbol").alias("market"), F.explode("m.history").alias("h"))
    return d.join(names, "market").select("symbol", F.timestamp_seconds("h.t").cast("timestamp_ntz").alias("ts"), *[F.col(f"h.{k}").alias(c) for k, c in fields.items()])


def fear_greed(raw: DataFrame) -> DataFrame:
    d = _items(raw, "struct<timestamp:string,value:string,value_classification:string>")
    return d.select(F.timestamp_seconds(F.col("x.timestamp").try_cast("bigint")).cast("timestamp_ntz").alias("ts"), number(F.col("x.value"), 50.0).alias("value"), F.coalesce("x.value_classification", F.lit("Neutral")).alias("label"))


def news(raw: DataFrame) -> DataFrame:
    """A row for each post and currency; posts without currencies are dropped."""
    d = raw.select(F.explode(F.from_json("payload", "struct<results:array<struct<published_at:string,currencies:array<struct<code:string>>,votes:struct<positive:bigint,negative:bigint,important:bigint>>>>")["results"]).alias("x"))
    d = d.select("x", F.explode("x.currencies").alias("c"))
    n = lambda v: F.coalesce(F.col(f"x.votes.{v}"), F.lit(0).cast("long"))
    out = d.select(F.concat(F.upper("c.code"), F.lit("USDT")).alias("symbol"), F.try_to_timestamp(F.substring("x.published_at", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz").alias("ts"), n("positive").alias("positive"), n("negative").alias("negative"), n("important").alias("neutral"))
    return out.withColumn("total", F.col("positive") + F.col("negative") + F.col("neutral"))


def other_interest(raw: DataFrame) -> DataFrame:
    """Open interest of another exchange: a payload for each symbol; without a time it counts as 1970, without a value as 0."""
    x = F.from_json("payload", "struct<symbol:string,openInterest:string,time:bigint>")
    d = raw.select(x.alias("x")).where("x.symbol IS NOT NULL")
    return d.select(F.col("x.symbol").alias("symbol"), F.timestamp_millis(F.coalesce("x.time", F.lit(0).cast("long"))).cast("timestamp_ntz").alias("ts"), number(F.col("x.openInterest"), 0.0).alias("oi_value"))


def other_funding(raw: DataFrame, suffix: str = "USDT") -> DataFrame:
    d = raw.select(F.explode(F.from_json("payload", "array<struct<symbol:string,fundingTime:bigint,fundingRate:string>>")).alias("x"))
    return d.select(F.col("x.symbol").alias("symbol"), F.timestamp_millis("x.fundingTime").cast("timestamp_ntz").alias("ts"), number(F.col("x.fundingRate"), 0.0).alias("funding_rate")).where(F.endswith("symbol", F.lit(suffix)))
