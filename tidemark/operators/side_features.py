"""Features of order books, derivatives, funding, sentiment and other exchanges, in time order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import lagged, last_rows, pct, ratio, rolling, zscore

S = ("symbol",)
#: Names and order of the features of each kind, as models take them.
ORDERBOOK = ["ob_imbalance", "ob_spread_bps", "ob_depth_ratio", "ob_total_depth", "ob_imbalance_change", "ob_spread_change"]
DERIVATIVES = ["oi_change_pct", "oi_zscore", "liq_imbalance", "liq_spike", "ls_ratio", "ls_ratio_extreme"]
FUNDING = ["fr_rate", "fr_rate_zscore", "fr_rate_momentum", "fr_mark_spot_divergence"]
CROSS = ["btc_return_1h", "correlation_to_btc", "btc_dominance_proxy"]
SENTIMENT = ["fear_greed_index", "fear_greed_change", "news_sentiment_score", "news_volume_zscore"]
EXCHANGE = ["funding_rate_spread", "oi_divergence"]


def total(a: Column | str) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def orderbook(books: DataFrame) -> DataFrame:
    """books(symbol, ts, bid_vols, ask_vols, spread, mid_price) with the six book features; an imbalance that is stored with a
    book is taken as it is."""
    d = books.withColumns({"_b": total("bid_vols"), "_a": total("ask_vols")})
    imbalance = F.col("imbalance").try_cast("double") if "imbalance" in books.columns else ratio("_b", F.col("_b") + F.col("_a"))
    d = d.withColumns({"ob_imbalance": imbalance, "ob_spread_bps": 1e4 * ratio("spread", "mid_price"), "ob_depth_ratio": ratio("_b", "_a"), "ob_total_depth": F.col("_b") + F.col("_a")})
    return d.withColumns({"ob_imbalance_change": F.col("ob_imbalance") - lagged("ob_imbalance", 1, S), "ob_spread_change": F.col("ob_spread_bps") - lagged("ob_spread_bps", 1, S)}).drop("_b", "_a")


def book_walls(books: DataFrame) -> DataFrame:
    """Imbalance change over 4, wall ratios (largest over mean volume), wall places and depth concentration."""

    def walls(side: str) -> dict[str, Column]:
        v = F.col(f"{side}_vols")
        return {f"{side}_wall_ratio": ratio(F.array_max(v), total(v) / F.size(v)), f"{side}_wall_level": F.array_position(v, F.array_max(v)), f"{side}_concentration": F.aggregate(v, F.lit(0.0), lambda s, x: s + F.pow(ratio(x, total(v)), F.lit(2.0)))}

    d = books.withColumn("_i", ratio(total("bid_vols"), total("bid_vols") + total("ask_vols")))
    return d.withColumns(walls("bid") | walls("ask")).withColumn("imbalance_delta", F.col("_i") - lagged("_i", 4, S)).drop("_i")


def wall_distances(books: DataFrame) -> DataFrame:
    """books(.., bid_prices, bid_vols, ask_prices, ask_vols, spread, mid_price, atr) with spread_pct, and how far the largest
    bid and ask are from the mid price, in ATR."""
    wall = lambda side: F.get(F.col(f"{side}_prices"), F.array_position(f"{side}_vols", F.array_max(f"{side}_vols")).cast("int") - 1)
    return books.withColumns(
        {"spread_pct": ratio("spread", "mid_price"), "bid_wall_dist": ratio(F.col("mid_price") - wall("bid"), F.col("atr")), "ask_wall_dist": ratio(wall("ask") - F.col("mid_price"), F.col("atr"))}
    )


def derivatives(d: DataFrame, n: int = 24) -> DataFrame:
    """d(symbol, ts, oi_close, long_vol, short_vol, ratio) with open-interest, liquidation and long/short features."""
    d = d.withColumn("_t", F.coalesce("long_vol", F.lit(0.0)) + F.coalesce("short_vol", F.lit(0.0)) + 1e-10)
    return d.withColumns(
        {
            "oi_change_pct": pct("oi_close", 1, S), "oi_zscore": zscore("oi_close", 7 * n, key=S), "liq_imbalance": (F.coalesce("long_vol", F.lit(0.0)) - F.coalesce("short_vol", F.lit(0.0))) / F.col("_t"),
            "liq_spike": ratio(F.col("_t"), rolling(F.avg, "_t", n, key=S)), "ls_ratio": F.col("ratio"), "ls_ratio_extreme": zscore("ratio", n, key=S),
        }
    ).drop("_t")


def funding(fr: DataFrame, n: int = 168) -> DataFrame:
    r = F.col("funding_rate")
    return fr.withColumns({"fr_rate": r, "fr_rate_zscore": zscore("funding_rate", n, key=S), "fr_rate_momentum": r - lagged("funding_rate", 1, S), "fr_mark_spot_divergence": ratio(F.col("mark_price") - F.col("last_price"), F.col("last_price"))})


def cross_asset(bars: DataFrame, leader: str, n: int = 24) -> DataFrame:
    """bars with the leader's return, the rolling correlation with it and its share of the market's volume; NULL on the
    leader itself."""
    from tidemark.operators.joins import with_leader

    d = bars.withColumn("ret", pct("close"))
    market = d.groupBy("interval", "ts").agg(F.sum("volume").alias("_market"))
    d = with_leader(d, leader, ["ret", "volume"]).join(market, ["interval", "ts"])
    both = F.count(F.when(F.col("ret").isNotNull() & F.col("leader_ret").isNotNull(), 1)).over(last_rows(n))
    own = F.col("symbol") != leader
    moving = (F.coalesce(F.var_pop("ret").over(last_rows(n)), F.lit(0.0)) > 1e-12) & (F.coalesce(F.var_pop("leader_ret").over(last_rows(n)), F.lit(0.0)) > 1e-12)
    return d.withColumns(
        {"btc_return_1h": F.when(own, F.col("leader_ret")), "correlation_to_btc": F.when(own & (both == n) & moving, F.corr("ret", "leader_ret").over(last_rows(n))), "btc_dominance_proxy": F.when(own, ratio("leader_volume", "_market"))}
    ).drop("ret", "leader_ret", "leader_volume", "_market")


def sentiment_index(fg: DataFrame) -> DataFrame:
    """Market-wide index over 100 and its change; one row a day, so the unkeyed window is small."""
    from pyspark.sql import Window

    return fg.select("ts", (F.col("value") / 100).alias("fear_greed_index"), (F.col("value") / 100 - F.lag(F.col("value") / 100).over(Window.orderBy("ts"))).alias("fear_greed_change"))


def news(n: DataFrame, rows: int = 168) -> DataFrame:
    return n.withColumns({"news_sentiment_score": ratio(F.col("positive") - F.col("negative"), F.col("total")), "news_volume_zscore": zscore(F.col("total").cast("double"), rows, 2, S)})


def feature_vector(bars: DataFrame, sides: list[tuple[DataFrame, list[str], str]]) -> DataFrame:
    """bars with the features of each side series, as of each candle ("as_of"), at its exact time ("exact") or by time
    alone ("time"); missing ones are 0. The series by symbol go over the bars together."""
    from tidemark.operators.joins import Side, as_of_all, exact

    by_symbol = [Side(side, names, 0 if how == "exact" else None, dict.fromkeys(names, 0.0)) for side, names, how in sides if how != "time"]
    for side, names, how in sides:
        if how == "time":
            bars = exact(bars, side, names, ["ts"])
    return as_of_all(bars, by_symbol) if by_symbol else bars


def exchange(own_funding: DataFrame, other_funding: DataFrame, interest: DataFrame, own_interest: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(symbol, ts, funding_rate_spread): both funding rates carried forward over the times of either, other less own; and
    (symbol, ts, oi_divergence): the other exchange's open-interest change, less our own where that is given."""
    from tidemark.operators.joins import filled_outer

    spread = filled_outer(other_funding, own_funding, "funding_rate").select("symbol", "ts", (F.col("a_value") - F.col("b_value")).alias("funding_rate_spread"))
    change = interest.select("symbol", "ts", pct("oi_value", 1, S).alias("oi_divergence"))
    if own_interest is not None:
        own = own_interest.select("symbol", "ts", pct("oi_close", 1, S).alias("_own"))
        change = change.join(own, ["symbol", "ts"], "left").select("symbol", "ts", (F.col("oi_divergence") - F.col("_own")).alias("oi_divergence"))
    return spread, change


def feature_columns() -> list[str]:
    """The 66 model features in order."""
    from tidemark.operators.indicators import NAMES

    return [*NAMES, *ORDERBOOK, *DERIVATIVES, *FUNDING, *CROSS, *SENTIMENT, *EXCHANGE]
