"""Technical indicators of candles, one window specification a series; recursive ones through functions.recursive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import chunks
from tidemark.functions.columns import KEY, lagged, last_rows, pct, ratio, rolling, so_far
from tidemark.functions.recursive import Smooth, ema, smooth, wilder_seeded

WARMUP = 168


def momentum(bars: DataFrame) -> DataFrame:
    """Williams %R, rate of change, price changes, positions in range, acceleration."""
    c = F.col("close")
    hi, lo = rolling(F.max, "high", 14), rolling(F.min, "low", 14)
    out = {"williams_r": -100 * ratio(hi - c, hi - lo), "roc_12": 100 * pct("close", 12)}
    out |= {f"pct_change_{k}": pct("close", k) for k in (1, 4, 24, 72, 168)}
    for n in (48, 168):
        h, low = rolling(F.max, "high", n), rolling(F.min, "low", n)
        out[f"price_position_{n}"] = ratio(c - low, h - low)
    return bars.withColumns(out).withColumn("momentum_accel", F.col("pct_change_4") - F.col("pct_change_24") / 6)


def bands(bars: DataFrame) -> DataFrame:
    """Bollinger and Keltner bands; their distances in ATR need the column atr."""
    c = F.col("close")
    d = bars.withColumns({"_mid": rolling(F.avg, "close", 20), "_sd": rolling(F.stddev_pop, "close", 20)})
    d = d.withColumns({"bb_upper": F.col("_mid") + 2 * F.col("_sd"), "bb_lower": F.col("_mid") - 2 * F.col("_sd")})
    d = d.withColumns({"bb_width": 100 * ratio(4 * F.col("_sd"), F.col("_mid")), "bb_pct": ratio(c - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower"))})
    up, down = (4 * F.col("high") - 2 * F.col("low") + c) / 3, (-2 * F.col("high") + 4 * F.col("low") + c) / 3
    d = d.withColumns({"_u": up, "_d": down})
    return d.withColumns({"kc_upper": rolling(F.avg, "_u", 20), "kc_lower": rolling(F.avg, "_d", 20)}).withColumn("kc_width", ratio(F.col("kc_upper") - F.col("kc_lower"), c)).drop("_mid", "_sd", "_u", "_d")


def flows(bars: DataFrame) -> DataFrame:
    """bars with obv_flow and ad_flow, what a bar adds to on-balance volume and to accumulation/distribution."""
    c, v, h, low = (F.col(x) for x in ("close", "volume", "high", "low"))
    ad = F.coalesce(ratio(v * ((c - low) - (h - c)), h - low), F.lit(0.0))
    return bars.withColumn("_pc", lagged("close")).withColumns({"obv_flow": F.when(c < F.col("_pc"), -v).otherwise(v), "ad_flow": ad}).drop("_pc")


def volume(bars: DataFrame) -> DataFrame:
    """On-balance volume and accumulation/distribution changes, volume ratios, VWAP. The two running totals are windows over a
    whole series, unless bars bring them as obv and acc_dist (volume_in_pieces)."""
    c, v, h, low = (F.col(x) for x in ("close", "volume", "high", "low"))
    d = bars
    if not {"obv", "acc_dist"} <= set(bars.columns):
        d = flows(bars).withColumns({"obv": F.sum("obv_flow").over(so_far()), "acc_dist": F.sum("ad_flow").over(so_far())}).drop("obv_flow", "ad_flow")
    d = d.withColumn("_tp", (h + low + c) / 3)
    sd = rolling(F.stddev_samp, "volume", 20)
    mean = rolling(F.avg, "volume", 20)
    d = d.withColumns({
        "obv_roc": pct("obv", 5), "acc_dist_roc": pct("acc_dist", 5), "vol_sma_ratio": ratio(v, mean), "vol_z_score": F.when(sd > 1e-12, (v - mean) / sd),
        "vwap": ratio(F.sum(F.col("_tp") * v).over(last_rows(24)), F.sum(v).over(last_rows(24))),
    })
    move = F.abs(pct("close"))
    return d.withColumn("vol_price_ratio", ratio(F.col("vol_sma_ratio"), F.when(move != 0, 100 * move + 0.01))).drop("_tp", "obv", "acc_dist")


def volume_in_pieces(bars: DataFrame, size: int = 50_000, bucket: str = "1 day") -> DataFrame:
    """volume() of series of any length: what looks back some rows is worked out in pieces, the two running totals in two
    levels, so no task sees a whole series."""
    d = chunks.in_pieces(bars, flows, 1, size, bucket)
    d = chunks.running_totals(d, {"obv": "obv_flow", "acc_dist": "ad_flow"}, bucket).drop("obv_flow", "ad_flow")
    return chunks.in_pieces(d, volume, 24, size, bucket)


def shape(bars: DataFrame) -> DataFrame:
    """Candle body and wicks over the range."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return bars.withColumns({"candle_body_ratio": ratio(c - o, h - low), "upper_wick_ratio": ratio(h - F.greatest(o, c), h - low), "lower_wick_ratio": ratio(F.least(o, c) - low, h - low)})


def trend(bars: DataFrame) -> DataFrame:
    """EMAs, MACD, ATR, RSI, ADX and what is measured in ATR. Two rounds of smoothing: the second smooths what the first made."""
    c, h, low = F.col("close"), F.col("high"), F.col("low")
    d = bars.withColumns({"_pc": lagged("close"), "_ph": lagged("high"), "_pl": lagged("low")})
    tr = F.when(F.col("_pc").isNull(), h - low).otherwise(F.greatest(h - low, F.abs(h - F.col("_pc")), F.abs(low - F.col("_pc"))))
    up, down = h - F.col("_ph"), F.col("_pl") - low
    d = d.withColumns(
        {
            "_tr": tr, "_tr1": F.when(F.col("_pc").isNotNull(), tr), "_up": F.greatest(c - F.col("_pc"), F.lit(0.0)), "_dn": F.greatest(F.col("_pc") - c, F.lit(0.0)),
            "_pdm": F.when((up > down) & (up > 0), up).when(up.isNotNull(), 0.0), "_ndm": F.when((down > up) & (down > 0), down).when(up.isNotNull(), 0.0),
        }
    )
    d = d.withColumns({"_up": F.when(F.col("_pc").isNotNull(), F.col("_up")), "_dn": F.when(F.col("_pc").isNotNull(), F.col("_dn"))})
    d = wilder_seeded(d, {x: f"{x}s" for x in ("_tr", "_tr1", "_pdm", "_ndm")})
    a = 1 / 14
    d = smooth(d, [ema("close", f"ema_{n}", n) for n in (9, 12, 21, 26, 50)] + [Smooth("_trs", "atr", a), Smooth("_tr1s", "_atr1", a), Smooth("_pdms", "_p", a), Smooth("_ndms", "_n", a), Smooth("_up", "_u", a, 13), Smooth("_dn", "_d", a, 13)])
    plus, minus = 100 * ratio("_p", "_atr1"), 100 * ratio("_n", "_atr1")
    d = d.withColumns({"macd": F.col("ema_12") - F.col("ema_26"), "adx_pos": plus, "adx_neg": minus})
    d = d.withColumn("_dx", F.when(F.col("adx_pos").isNotNull(), F.coalesce(100 * ratio(F.abs(F.col("adx_pos") - F.col("adx_neg")), F.col("adx_pos") + F.col("adx_neg")), F.lit(0.0))))
    d = wilder_seeded(d, {"_dx": "_dxs"})
    d = smooth(d, [ema("macd", "macd_signal", 9), Smooth("_dxs", "adx", a)])
    rsi = F.when(F.col("_d") == 0, 100.0).otherwise(100 - 100 / (1 + ratio("_u", "_d")))
    out = {"rsi_14": F.when(F.col("_u").isNotNull(), rsi), "atr_pct": ratio("atr", "close"), "macd_norm": ratio("macd", "close"), "macd_signal_norm": ratio("macd_signal", "close"), "macd_hist_norm": ratio(F.col("macd") - F.col("macd_signal"), c)}
    out |= {f"ema_{n}_dist": ratio(c - F.col(f"ema_{n}"), F.col("atr")) for n in (9, 21, 50)}
    out |= {f"ema_{a}_{b}_cross": F.when(F.col(f"ema_{a}") > F.col(f"ema_{b}"), 1.0).otherwise(0.0) for a, b in ((9, 21), (21, 50))}
    d = d.withColumns(out).withColumn("atr_expansion", ratio(F.col("atr"), rolling(F.avg, "atr", 48)))
    low14, high14 = rolling(F.min, "rsi_14", 14), rolling(F.max, "rsi_14", 14)
    d = d.withColumn("_stoch", ratio(F.col("rsi_14") - low14, high14 - low14))
    d = d.withColumn("stoch_rsi_k", rolling(F.avg, "_stoch", 3))
    d = d.withColumn("stoch_rsi_d", rolling(F.avg, "stoch_rsi_k", 3))
    return d.drop(*[x for x in d.columns if x.startswith("_")])


#: The 41 columns of compute() in the order in which models take them.
NAMES = (
    ["ema_9_dist", "ema_21_dist", "ema_50_dist", "macd_norm", "macd_signal_norm", "macd_hist_norm", "adx", "adx_pos", "adx_neg", "rsi_14", "stoch_rsi_k", "stoch_rsi_d", "williams_r", "roc_12", "bb_width", "bb_pct", "atr_pct", "kc_width", "kc_dist"]
    + ["obv_roc", "acc_dist_roc", "vol_sma_ratio", "vol_z_score", "vwap_dist", "pct_change_1", "pct_change_4", "pct_change_24", "pct_change_72", "pct_change_168"]
    + ["candle_body_ratio", "upper_wick_ratio", "lower_wick_ratio", "ema_9_21_cross", "ema_21_50_cross", "price_vs_bb_upper", "price_vs_bb_lower"]
    + ["price_position_48", "price_position_168", "momentum_accel", "atr_expansion", "vol_price_ratio"]
)


def compute(bars: DataFrame) -> DataFrame:
    """bars with all indicators, NULL while a window is not full."""
    d = trend(shape(volume(bands(momentum(bars)))))
    c, atr = F.col("close"), F.col("atr")
    d = d.withColumns(
        {"kc_dist": ratio(c - (F.col("kc_upper") + F.col("kc_lower")) / 2, atr), "vwap_dist": ratio(c - F.col("vwap"), atr), "price_vs_bb_upper": ratio(c - F.col("bb_upper"), atr), "price_vs_bb_lower": ratio(c - F.col("bb_lower"), atr)}
    )
    return d.select(*KEY, "ts", "open", "high", "low", "close", "volume", "atr", *NAMES)
