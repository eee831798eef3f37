"""Queries over indicators, side series and training windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import chunks
from tidemark.functions.recursive import ema, smooth
from tidemark.operators import dataset, indicators, regime, side_features
from tidemark.plans.registry import query
from tidemark.plans.sql import S, div, lag, pct, r, roll, sql, w, z
from tidemark.sources import bars

H = bars.candles
ID = ["symbol", "interval", "ts"]
IDS = 'symbol, "interval", ts'


def _pos(n: int) -> str:
    return div(f"close - {roll('min', 'low', n)}", f"{roll('max', 'high', n)} - {roll('min', 'low', n)}")


@query(
    sql(f"""SELECT {IDS}, {r('-100 * ' + div(roll('max', 'high', 14) + ' - close', roll('max', 'high', 14) + ' - ' + roll('min', 'low', 14)), 'williams_r')},
        {r('100 * ' + pct('close', 12), 'roc_12')},
    {', '.join(r(pct('close', k), f'pct_change_{k}') for k in (1, 4, 24, 72, 168))}, {r(_pos(48), 'price_position_48')}, {r(_pos(168), 'price_position_168')},
    {r(pct('close', 4) + ' - ' + pct('close', 24) + ' / 6', 'momentum_accel')} FROM candles_60""")
)
def momentum_indicators(spark, d):
    names = ["williams_r", "roc_12", *[f"pct_change_{k}" for k in (1, 4, 24, 72, 168)], "price_position_48", "price_position_168", "momentum_accel"]
    return indicators.momentum(H(spark, d)).select(*ID, *names)


@query(sql(f"""SELECT {IDS}, {r(_pos(168), 'price_position_168')}, {r(pct('close', 24), 'pct_change_24')} FROM candles_15"""))
def momentum_in_pieces(spark, d):
    """Window features of long series, each series cut into pieces with a halo."""
    x = chunks.in_pieces(H(spark, d, 15), indicators.momentum, indicators.WARMUP, size=400)
    return x.select(*ID, "price_position_168", "pct_change_24")


@query(
    sql(f"""WITH b AS (SELECT *, {roll('avg', 'close', 20)} AS mid, {roll('stddev_pop', 'close', 20)} AS sd,
        {roll('avg', '((4 * high - 2 * low + close) / 3)', 20)} AS ku, {roll('avg', '((-2 * high + 4 * low + close) / 3)', 20)} AS kl FROM candles_60)
    SELECT {IDS}, {r('100 * ' + div('4 * sd', 'mid'), 'bb_width')}, {r(div('close - (mid - 2 * sd)', '4 * sd'), 'bb_pct')},
    {r(div('ku - kl', 'close'), 'kc_width')} FROM b""")
)
def band_indicators(spark, d):
    return indicators.bands(H(spark, d)).select(*ID, "bb_width", "bb_pct", "kc_width")


_VOLUME = (
    f"""WITH b AS (SELECT *, sum(CASE WHEN close < pc THEN -volume ELSE volume END) OVER ({S} ROWS UNBOUNDED PRECEDING) AS obv,
        sum(coalesce({div('volume * ((close - low) - (high - close))', 'high - low')}, 0)) OVER ({S} ROWS UNBOUNDED PRECEDING) AS ad
      FROM (SELECT *, lag(close) OVER ({S}) AS pc, (high + low + close) / 3 AS tp FROM candles_60)),
    v AS (SELECT *, {div('volume', roll('avg', 'volume', 20))} AS ratio20, abs({pct('close')}) AS mv FROM b)
    SELECT {IDS}, {r('ratio20', 'vol_sma_ratio', 4)}, {r(z('volume', 20), 'vol_z_score', 4)}, {r(pct('obv', 5), 'obv_roc', 4)},
    {r(pct('ad', 5), 'acc_dist_roc', 4)},
      {r(div(f"sum(tp * volume) OVER {w(24)}", f"sum(volume) OVER {w(24)}"), 'vwap', 4)},
      {r(div('ratio20', 'CASE WHEN mv <> 0 THEN 100 * mv + 0.01 END'), 'vol_price_ratio', 4)} FROM v"""
)
VOLUME = ("vol_sma_ratio", "vol_z_score", "obv_roc", "acc_dist_roc", "vwap", "vol_price_ratio")


@query(sql(_VOLUME.replace("candles_60", "candles_15")), digits=4)
def volume_in_pieces(spark, d):
    """Volume features of long series: pieces with a halo, and running totals in two levels."""
    return indicators.volume_in_pieces(H(spark, d, 15), size=400).select(*ID, *VOLUME)


@query(sql(_VOLUME), digits=4)
def volume_indicators(spark, d):
    return indicators.volume(H(spark, d)).select(*ID, *VOLUME)


@query(sql(f"""SELECT {IDS}, {r(div('close - open', 'high - low'), 'candle_body_ratio')},
    {r(div('high - greatest(open, close)', 'high - low'), 'upper_wick_ratio')}, {r(div('least(open, close) - low', 'high - low'), 'lower_wick_ratio')}
    FROM candles_60"""))
def candle_shapes(spark, d):
    return indicators.shape(H(spark, d)).select(*ID, "candle_body_ratio", "upper_wick_ratio", "lower_wick_ratio")


# One pass over the rows of every symbol, by number: averages in a row are each other's input.
_RECURSIVE = f"""WITH n AS (SELECT *, row_number() OVER ({S}) AS i, lag(close) OVER ({S}) AS pc, lag(high) OVER ({S}) AS ph, lag(low) OVER ({S}) AS pl
    FROM candles_60),
  m AS (SELECT *, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr, CASE
  WHEN pc IS NOT NULL THEN greatest(close - pc, 0) END AS up, CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0) END AS dn,
    CASE WHEN ph IS NULL THEN NULL WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS pdm, CASE WHEN ph IS NULL THEN NULL
    WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS ndm FROM n),
  k AS (SELECT *, avg(tr) OVER {w(14)} AS tr14, avg(CASE WHEN i > 1 THEN tr END) OVER {w(14)} AS trb14, avg(pdm) OVER {w(14)} AS pdm14, avg(ndm)
  OVER {w(14)} AS ndm14 FROM m),
  rec AS (SELECT symbol, "interval", i, ts, close, close AS e9, close AS e12, close AS e21, close AS e26, close AS e50, CAST(NULL AS DOUBLE) AS atr,
  CAST(NULL AS DOUBLE) AS atr1, CAST(NULL AS DOUBLE) AS p, CAST(NULL AS DOUBLE) AS q, CAST(NULL AS DOUBLE) AS u, CAST(NULL AS DOUBLE) AS v FROM k WHERE i = 1
    UNION ALL SELECT k.symbol, k."interval", k.i, k.ts, k.close, r.e9 + (k.close - r.e9) * 2 / 10, r.e12 + (k.close - r.e12) * 2 / 13, r.e21 + (k.close - r.e21)
    * 2 / 22, r.e26 + (k.close - r.e26) * 2 / 27, r.e50 + (k.close - r.e50) * 2 / 51,
      CASE WHEN k.i = 14 THEN k.tr14 WHEN k.i > 14 THEN r.atr + (k.tr - r.atr) / 14 END, CASE WHEN k.i = 15 THEN k.trb14
      WHEN k.i > 15 THEN r.atr1 + (k.tr - r.atr1) / 14 END,
      CASE WHEN k.i = 15 THEN k.pdm14 WHEN k.i > 15 THEN r.p + (k.pdm - r.p) / 14 END, CASE WHEN k.i = 15 THEN k.ndm14 WHEN k.i > 15 THEN r.q + (k.ndm - r.q)
      / 14 END,
      CASE WHEN k.i = 2 THEN k.up ELSE r.u + (k.up - r.u) / 14 END, CASE WHEN k.i = 2 THEN k.dn ELSE r.v + (k.dn - r.v) / 14 END
    FROM rec r JOIN k ON k.symbol = r.symbol AND k."interval" = r."interval" AND k.i = r.i + 1)"""


@query(sql(f"""{_RECURSIVE} SELECT {IDS}, {', '.join(r(f'CASE WHEN i >= {n} THEN e{n} END', f'ema_{n}') for n in (9, 21, 50))} FROM rec""", recursive=True))
def exponential_averages(spark, d):
    return smooth(H(spark, d), [ema("close", f"ema_{n}", n) for n in (9, 21, 50)]).select(*ID, "ema_9", "ema_21", "ema_50")


@query(
    sql(f"""{_RECURSIVE} SELECT {IDS}, {r('atr', 'atr')}, {r('atr / close', 'atr_pct')},
        {r('CASE WHEN i < 14 THEN NULL WHEN v = 0 THEN 100 ELSE 100 - 100 / (1 + u / v) END', 'rsi_14')}, {r('100 * p / nullif(atr1, 0)', 'adx_pos')},
        {r('100 * q / nullif(atr1, 0)', 'adx_neg')},
    {r('(CASE WHEN i >= 26 THEN e12 - e26 END) / close', 'macd_norm')}, {r('(close - CASE WHEN i >= 21 THEN e21 END) / nullif(atr, 0)', 'ema_21_dist')},
    coalesce(CAST(CASE WHEN i >= 21 THEN e9 > e21 END AS DOUBLE), 0) AS ema_9_21_cross FROM rec""", recursive=True)
)
def trend_indicators(spark, d):
    return indicators.trend(H(spark, d)).select(*ID, "atr", "atr_pct", "rsi_14", "adx_pos", "adx_neg", "macd_norm", "ema_21_dist", "ema_9_21_cross")


_SECOND = f"""{_RECURSIVE}, x AS (SELECT *, CASE WHEN i >= 15 THEN coalesce(100 * abs(100 * p / nullif(atr1, 0) - 100 * q / nullif(atr1, 0))
    / nullif(100 * p / nullif(atr1, 0) + 100 * q / nullif(atr1, 0), 0), 0) END AS dx, CASE WHEN i >= 26 THEN e12 - e26 END AS macd FROM rec),
    y AS (SELECT *, avg(dx) OVER {w(14)} AS dx14 FROM x),
    z AS (SELECT symbol, "interval", i, ts, close, macd, macd AS sig, CAST(NULL AS DOUBLE) AS adx FROM y WHERE i = 1 UNION ALL
      SELECT y.symbol, y."interval", y.i, y.ts, y.close, y.macd, CASE WHEN y.i <= 26 THEN y.macd ELSE z.sig + (y.macd - z.sig) * 2 / 10 END, CASE
      WHEN y.i = 28 THEN y.dx14 WHEN y.i > 28 THEN z.adx + (y.dx - z.adx) / 14 END
      FROM z JOIN y ON y.symbol = z.symbol AND y."interval" = z."interval" AND y.i = z.i + 1)"""


@query(
    sql(f"""{_SECOND} SELECT {IDS}, {r('adx', 'adx')}, {r('CASE WHEN i >= 34 THEN sig END / close', 'macd_signal_norm')},
        {r('(macd - CASE WHEN i >= 34 THEN sig END) / close', 'macd_hist_norm')} FROM z""", recursive=True)
)
def second_order_indicators(spark, d):
    return indicators.trend(H(spark, d)).select(*ID, "adx", "macd_signal_norm", "macd_hist_norm")


def _if(n: int, x: str) -> str:
    return f"(CASE WHEN i >= {n} THEN {x} END)"


_SIGNAL = _if(34, "sig")
_EMA = {n: _if(n, f"e{n}") for n in (9, 21, 50)}
_OVER_ATR = lambda x: div(f"close - ({x})", "atr")
_CROSS = lambda a, b: f"coalesce(CAST({_EMA[a]} > {_EMA[b]} AS DOUBLE), 0)"
#: Each indicator as an expression over the columns that _ALL puts together.
_INDICATORS = {
    **{f"ema_{n}_dist": _OVER_ATR(_EMA[n]) for n in (9, 21, 50)},
    "macd_norm": div("macd", "close"), "macd_signal_norm": div(_SIGNAL, "close"), "macd_hist_norm": div(f"macd - {_SIGNAL}", "close"),
    "adx": "adx", "adx_pos": "100 * p / nullif(atr1, 0)", "adx_neg": "100 * q / nullif(atr1, 0)", "rsi_14": "rsi", "stoch_rsi_k": "stoch_k", "stoch_rsi_d": roll("avg", "stoch_k", 3),
    "williams_r": "-100 * " + div("h14 - close", "h14 - l14"), "roc_12": "100 * " + pct("close", 12), "bb_width": "100 * " + div("4 * sd", "mid"), "bb_pct": div("close - (mid - 2 * sd)", "4 * sd"),
    "atr_pct": div("atr", "close"), "kc_width": div("ku - kl", "close"), "kc_dist": _OVER_ATR("(ku + kl) / 2"),
    "obv_roc": pct("obv", 5), "acc_dist_roc": pct("ad", 5), "vol_sma_ratio": "ratio20", "vol_z_score": z("volume", 20), "vwap_dist": _OVER_ATR("vwap"),
    **{f"pct_change_{k}": pct("close", k) for k in (1, 4, 24, 72, 168)},
    "candle_body_ratio": div("close - open", "high - low"), "upper_wick_ratio": div("high - greatest(open, close)", "high - low"), "lower_wick_ratio": div("least(open, close) - low", "high - low"),
    "ema_9_21_cross": _CROSS(9, 21), "ema_21_50_cross": _CROSS(21, 50), "price_vs_bb_upper": _OVER_ATR("mid + 2 * sd"), "price_vs_bb_lower": _OVER_ATR("mid - 2 * sd"),
    "price_position_48": _pos(48), "price_position_168": _pos(168), "momentum_accel": pct("close", 4) + " - " + pct("close", 24) + " / 6",
    "atr_expansion": div("atr", roll("avg", "atr", 48)), "vol_price_ratio": div("ratio20", "CASE WHEN mv <> 0 THEN 100 * mv + 0.01 END"),
}
_ALL = f"""{_SECOND},
  w0 AS (SELECT *, lag(close) OVER ({S}) AS pc, (high + low + close) / 3 AS tp, {roll('max', 'high', 14)} AS h14, {roll('min', 'low', 14)} AS l14,
  {roll('avg', 'close', 20)} AS mid, {roll('stddev_pop', 'close', 20)} AS sd,
    {roll('avg', '((4 * high - 2 * low + close) / 3)', 20)} AS ku, {roll('avg', '((-2 * high + 4 * low + close) / 3)', 20)} AS kl FROM candles_60),
  w1 AS (SELECT *, sum(CASE WHEN close < pc THEN -volume ELSE volume END) OVER ({S} ROWS UNBOUNDED PRECEDING) AS obv,
  sum(coalesce({div('volume * ((close - low) - (high - close))', 'high - low')}, 0)) OVER ({S} ROWS UNBOUNDED PRECEDING) AS ad,
    {div('volume', roll('avg', 'volume', 20))} AS ratio20, abs({pct('close')}) AS mv,
    {div(f"sum(tp * volume) OVER {w(24)}", f"sum(volume) OVER {w(24)}")} AS vwap FROM w0),
  w2 AS (SELECT w1.*, rec.i, e9, e21, e50, atr, atr1, p, q, CASE WHEN rec.i < 14 THEN NULL WHEN v = 0 THEN 100 ELSE 100 - 100 / (1 + u / v) END AS rsi, z.macd,
  z.sig, z.adx
    FROM w1 JOIN rec USING (symbol, "interval", ts) JOIN z USING (symbol, "interval", ts)),
  w3 AS (SELECT *, {div(f"rsi - {roll('min', 'rsi', 14)}", f"{roll('max', 'rsi', 14)} - {roll('min', 'rsi', 14)}")} AS stoch FROM w2),
  w4 AS (SELECT *, {roll('avg', 'stoch', 3)} AS stoch_k FROM w3)"""


@query(
    sql(f"""{_ALL} SELECT {IDS}, {', '.join(r(c, c, 4) for c in ('open', 'high', 'low', 'close', 'volume', 'atr'))},
        {', '.join(r(x, n, 4) for n, x in _INDICATORS.items())} FROM w4""", recursive=True),
    digits=4,
)
def all_indicators(spark, d):
    """The 41 columns together."""
    return indicators.compute(H(spark, d))


_B, _A = "list_sum(bid_vols)", "list_sum(ask_vols)"
_OB = f"(SELECT symbol, ts, {_B} / ({_B} + {_A}) AS i, 1e4 * (ask_vols[1] - bid_vols[1]) / nullif((ask_vols[1] + bid_vols[1]) / 2, 0) AS s, {_B} / nullif({_A}, 0) AS dr, {_B} + {_A} AS td FROM order_book)"


def books(spark, d):
    bid, ask = F.get("bid_vols", 0), F.get("ask_vols", 0)
    return bars.order_book(spark, d).withColumns({"spread": ask - bid, "mid_price": (ask + bid) / 2})


@query(
    sql(f"""SELECT symbol, ts, {r('i', 'ob_imbalance', 4)}, {r('s', 'ob_spread_bps', 4)}, {r('dr', 'ob_depth_ratio', 4)}, {r('td', 'ob_total_depth', 4)},
        {r('i - ' + lag('i', 1, 'symbol'), 'ob_imbalance_change', 4)}, {r('s - ' + lag('s', 1, 'symbol'), 'ob_spread_change', 4)} FROM {_OB}"""),
    digits=4,
)
def order_book_features(spark, d):
    return side_features.orderbook(books(spark, d)).select("symbol", "ts", *side_features.ORDERBOOK)


@query(
    sql(f"""SELECT symbol, ts, {r('list_max(bid_vols) / (list_sum(bid_vols) / len(bid_vols))', 'bid_wall_ratio')},
        {r('list_max(ask_vols) / (list_sum(ask_vols) / len(ask_vols))', 'ask_wall_ratio')}, CAST(list_position(bid_vols, list_max(bid_vols)) AS BIGINT)
        AS bid_wall_level,
    {r('list_sum(list_transform(bid_vols, lambda x: x * x)) / (list_sum(bid_vols) * list_sum(bid_vols))', 'bid_concentration')},
    {r(f"{_B} / ({_B} + {_A}) - lag({_B} / ({_B} + {_A}), 4) OVER (PARTITION BY symbol ORDER BY ts)", 'imbalance_delta')} FROM order_book""")
)
def order_book_walls(spark, d):
    return side_features.book_walls(bars.order_book(spark, d)).select("symbol", "ts", "bid_wall_ratio", "ask_wall_ratio", F.col("bid_wall_level").cast("long").alias("bid_wall_level"), "bid_concentration", "imbalance_delta")


@query(
    sql(f"""WITH w AS (SELECT symbol, ts, (bid_vols[1] + ask_vols[1]) / 2 AS mid, ask_vols[1] - bid_vols[1] AS spread, list_position(bid_vols,
        list_max(bid_vols)) AS b, list_position(ask_vols, list_max(ask_vols)) AS a FROM order_book)
    SELECT symbol, ts, {r('spread / mid', 'spread_pct')}, {r('0.25 * b / (mid / 50 + 1)', 'bid_wall_dist')}, {r('0.5 * a / (mid / 50 + 1)', 'ask_wall_dist')}
    FROM w""")
)
def order_book_wall_distances(spark, d):
    """How far the largest orders are from the mid price; bids are priced 0.25 apart under it, asks 0.5 apart over it, and a
    part of the mid price stands for the ATR."""
    level = lambda side, step: F.transform(f"{side}_vols", lambda _, i: F.col("mid_price") + (i + 1) * step)
    b = books(spark, d).withColumns({"bid_prices": level("bid", -0.25), "ask_prices": level("ask", 0.5), "atr": F.col("mid_price") / 50 + 1})
    return side_features.wall_distances(b).select("symbol", "ts", "spread_pct", "bid_wall_dist", "ask_wall_dist")


@query(
    sql(f"""WITH t AS (SELECT *, long_vol + short_vol + 1e-10 AS tot FROM derivatives) SELECT symbol, ts, {r(pct('oi_close', 1, 'symbol'), 'oi_change_pct')},
        {r(z('oi_close', 168, None, 'symbol'), 'oi_zscore')}, {r('(long_vol - short_vol) / tot', 'liq_imbalance')},
    {r(div('tot', roll('avg', 'tot', 24, None, 'symbol')), 'liq_spike')}, {r('ratio', 'ls_ratio')}, {r(z('ratio', 24, None, 'symbol'), 'ls_ratio_extreme')}
    FROM t""")
)
def derivatives_features(spark, d):
    return side_features.derivatives(bars.derivatives(spark, d)).select("symbol", "ts", *side_features.DERIVATIVES)


@query(
    sql(f"""SELECT symbol, ts, {r('funding_rate', 'fr_rate')}, {r(z('funding_rate', 24, None, 'symbol'), 'fr_rate_zscore')},
        {r('funding_rate - ' + lag('funding_rate', 1, 'symbol'), 'fr_rate_momentum')},
        {r('(mark_price - last_price) / nullif(last_price, 0)', 'fr_mark_spot_divergence')} FROM funding""")
)
def funding_features(spark, d):
    return side_features.funding(bars.funding(spark, d), 24).select("symbol", "ts", *side_features.FUNDING)


_LD = f"""WITH rt AS (SELECT *, {pct('close')} AS ret FROM candles_60), mk AS (SELECT "interval", ts, sum(volume) AS market FROM candles_60 GROUP BY ALL),
  j AS (SELECT rt.symbol, rt."interval", rt.ts, rt.ret, l.ret AS lret, l.volume AS lvol, mk.market FROM rt JOIN mk ON rt.ts = mk.ts
  AND rt."interval" = mk."interval" LEFT JOIN (SELECT * FROM rt WHERE symbol = 'click') l ON rt.ts = l.ts)"""


@query(
    sql(f"""{_LD} SELECT {IDS}, {r('lret', 'btc_return_1h')}, {r('lvol / nullif(market, 0)', 'btc_dominance_proxy')},
        {r(f'''CASE WHEN count(CASE WHEN ret IS NOT NULL AND lret IS NOT NULL THEN 1 END) OVER {w(24)} = 24 AND var_pop(ret) OVER {w(24)} > 1e-12 AND var_pop(lret) OVER {w(24)} > 1e-12 THEN corr(ret, lret) OVER {w(24)} END''', 'correlation_to_btc')}
    FROM j WHERE symbol <> 'click'""")
)
def cross_asset_features(spark, d):
    return side_features.cross_asset(H(spark, d), "click").where("symbol <> 'click'").select(*ID, *side_features.CROSS)


@query(sql(f"""SELECT ts, {r('value / 100', 'fear_greed_index')}, {r('value / 100 - lag(value / 100) OVER (ORDER BY ts)', 'fear_greed_change')} FROM fear_greed"""))
def fear_greed_features(spark, d):
    return side_features.sentiment_index(bars.fear_greed(spark, d))


@query(sql(f"""WITH n AS (SELECT *, CAST(total AS DOUBLE) AS t FROM news) SELECT symbol, ts,
    {r('(positive - negative) / nullif(total, 0)', 'news_sentiment_score')}, {r(z('t', 168, 2, 'symbol'), 'news_volume_zscore')} FROM n"""))
def news_features(spark, d):
    return side_features.news(bars.news(spark, d)).select("symbol", "ts", "news_sentiment_score", "news_volume_zscore")


@query(
    sql(f"""SELECT c.symbol, c."interval", c.ts, coalesce(round(o.i, 8), 0) + 0.0 AS ob_imbalance, coalesce(round(x.ls, 8), 0) + 0.0 AS ls_ratio,
        coalesce(round(f.funding_rate, 8), 0) + 0.0 AS fr_rate, coalesce(round(g.value / 100, 8), 0) + 0.0 AS fear_greed_index
    FROM candles_60 c ASOF LEFT JOIN {_OB} o ON c.symbol = o.symbol AND c.ts >= o.ts LEFT JOIN (SELECT symbol, ts, ratio AS ls FROM derivatives)
    x ON c.symbol = x.symbol AND c.ts = x.ts
    ASOF LEFT JOIN funding f ON c.symbol = f.symbol AND c.ts >= f.ts LEFT JOIN fear_greed g ON c.ts = g.ts"""),
    digits=8,
)
def feature_vector(spark, d):
    """Candles with book and funding features as of each, derivatives at its time, sentiment by time; missing ones 0."""
    sides = [
        (side_features.orderbook(books(spark, d)), ["ob_imbalance"], "as_of"),
        (side_features.derivatives(bars.derivatives(spark, d)), ["ls_ratio"], "exact"),
        (side_features.funding(bars.funding(spark, d)), ["fr_rate"], "as_of"),
        (side_features.sentiment_index(bars.fear_greed(spark, d)), ["fear_greed_index"], "time"),
    ]
    return side_features.feature_vector(H(spark, d), sides).select(*ID, "ob_imbalance", "ls_ratio", "fr_rate", "fear_greed_index")


_RG = f"""WITH b AS (SELECT *, {pct('close', 1)} AS r1, {pct('close', 4)} AS r4, {pct('volume', 1)} AS vc FROM candles_60 WHERE symbol = 'click'),
  f AS (SELECT {IDS}, coalesce(r1, 0) AS ret1, coalesce(r4, 0) AS ret4, coalesce({roll('stddev_samp', 'r1', 24)}, 1e-10) AS vol24,
  {roll('avg', 'r1', 48)} AS m48, greatest(-5, least(5, coalesce(vc, 0))) AS volume_change FROM b)"""


@query(
    sql(f"""{_RG} SELECT {IDS}, {r('ret1', 'ret1')}, {r('ret4', 'ret4')}, {r('vol24', 'vol24')}, {r('coalesce(abs(m48) / nullif(vol24, 0), 0)', 'trend')},
        {r('volume_change', 'volume_change')}, CASE WHEN vol24 > 2 THEN 'HIGH_VOL' WHEN ret1 > 0.005 THEN 'UP' WHEN ret1 < -0.005 THEN 'DOWN' ELSE 'RANGING'
        END AS regime FROM f""")
)
def regime_rules(spark, d):
    f = regime.features(H(spark, d).where("symbol = 'click'"))
    return regime.classified(f, vol=2.0).select(*ID, "ret1", "ret4", "vol24", "trend", "volume_change", "regime")


@query(
    sql(f"""WITH s AS (SELECT *, CASE WHEN k < 25 THEN 'UP' WHEN k < 50 THEN 'DOWN' WHEN k < 75 THEN 'RANGING' ELSE 'HIGH_VOL' END AS regime FROM predictions)
    SELECT {IDS}, {r("CAST(k * CASE regime WHEN 'UP' THEN 1.2 WHEN 'DOWN' THEN 1.0 WHEN 'RANGING' THEN 0.7 ELSE 0.5 END AS DOUBLE)", 'score')},
    {r("greatest(0, least(1, prob_up + CASE regime WHEN 'UP' THEN 0.1 WHEN 'DOWN' THEN 0.05 WHEN 'RANGING' THEN -0.1 ELSE -0.15 END))", 'conviction')},
    {r("CAST(CASE regime WHEN 'RANGING' THEN 0.002 WHEN 'HIGH_VOL' THEN 0.003 ELSE 0 END AS DOUBLE)", 'threshold_change')} FROM s""")
)
def regime_adjustment(spark, d):
    k = F.col("k")
    p = bars.predictions(spark, d).withColumn("regime", F.when(k < 25, "UP").when(k < 50, "DOWN").when(k < 75, "RANGING").otherwise("HIGH_VOL"))
    return regime.adjusted(p.withColumns({"score": k.cast("double"), "conviction": F.col("prob_up")})).select(*ID, "score", "conviction", "threshold_change")


@query()
def regime_mixture(spark, d):
    """A mixture model's states of the leader's candles, named."""
    return regime.fitted(regime.features(H(spark, d).where("symbol = 'click'"))).select(*ID, "state", "regime")


@query(sql(f"""SELECT {IDS}, {r(f"(lead(close, 2) OVER ({S}) - close) / close", 'forward_pct')}, CAST(CASE WHEN (lead(close, 2) OVER ({S}) - close)
    / close > 0.5 THEN 0 WHEN (lead(close, 2) OVER ({S}) - close) / close < -0.5 THEN 2 WHEN lead(close, 2) OVER ({S}) IS NOT NULL THEN 1 END AS INTEGER)
    AS label FROM candles_60"""))
def forward_labels(spark, d):
    return dataset.labelled(H(spark, d), 2, 0.5).select(*ID, "forward_pct", "label")


_WN = f"(PARTITION BY symbol, \"interval\" ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"


@query(
    sql(f"""WITH l AS (SELECT *, lead(close) OVER ({S}) AS nx, count(*) OVER {_WN} AS n, avg(close) OVER {_WN} AS mean, stddev_pop(close) OVER {_WN} AS sd,
        first_value(close) OVER {_WN} AS f, last_value(close) OVER {_WN} AS la FROM candles_60)
    SELECT {IDS}, {r('la', 'last_close')}, {r('mean', 'mean_close')}, {r('sd', 'std_close')}, {r('la - f', 'delta_close')},
    {r('(la - mean) / CASE WHEN sd > 1e-12 THEN sd ELSE 1 END', 'last_z')} FROM l WHERE n = 24 AND nx IS NOT NULL""")
)
def training_windows(spark, d):
    """Sliding windows of 24 rows with the label of the row after: flattened features and the z-score of the last step."""
    x = dataset.windows(dataset.labelled(H(spark, d), 1, 0.5), ["close", "volume"], 24)
    x = dataset.flattened(x, ["close", "volume"])
    return dataset.normalized(x).select(*ID, "last_close", "mean_close", "std_close", "delta_close", F.get(F.element_at("window", -1), 0).alias("last_z"))


@query(sql(f"""SELECT {IDS} FROM (SELECT *, count(*) OVER {w(24)} AS n, stddev_pop(close) OVER {w(24)} AS sd FROM candles_60) WHERE n = 24 AND sd >= 1e-8"""))
def live_windows(spark, d):
    return dataset.live_windows(H(spark, d), 24).select(*ID)


@query(
    sql("""WITH t AS (SELECT ts, row_number() OVER (ORDER BY ts) AS t, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM candles_60)), c AS (SELECT ts, t,
        fold, floor(0.3 * n) + fold * greatest(1, floor((n - floor(0.3 * n)) / 5)) AS cut, greatest(1, floor((n - floor(0.3 * n)) / 5)) AS size FROM t CROSS
        JOIN range(5) f(fold))
    SELECT CAST(fold AS INTEGER) AS fold, part, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT c.*, CASE WHEN t <= cut THEN 'train'
    WHEN t <= cut + size THEN 'val' END AS part FROM c) JOIN candles_60 USING (ts) WHERE part IS NOT NULL GROUP BY 1, 2""")
)
def walk_forward_splits(spark, d):
    x = dataset.walk_forward(H(spark, d))
    return x.groupBy("fold", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(sql(f"""SELECT {IDS}, CASE WHEN row_number() OVER ({S}) <= floor(0.7 * count(*) OVER (PARTITION BY symbol, "interval") + 1e-9) THEN 'train' ELSE 'val'
    END AS part FROM candles_60"""))
def row_split(spark, d):
    return dataset.row_split(H(spark, d)).select(*ID, "part")


@query(sql("""SELECT symbol, "interval", ts FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n2 FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n
    FROM candles_user) WHERE n >= 20 AND ts >= TIMESTAMP '2024-01-10') WHERE n2 >= 20"""))
def rolling_days_cut(spark, d):
    return dataset.rolling_cut(bars.user_candles(spark, d), F.lit("2024-01-31").cast("timestamp_ntz"), 21, 20).select(*ID)


@query(
    sql(f"""WITH c AS (SELECT *, CASE WHEN symbol = 'click' THEN 3.0 ELSE 1.0 END::DOUBLE AS weight,
        CAST('0x' || substr(md5('7|' || symbol || '|' || "interval" || '|' || CAST(ts AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
        FROM candles_60),
    x AS (SELECT *, weight / avg(weight) OVER (PARTITION BY "interval") AS m FROM c), k AS (SELECT *, unnest(range(60)) AS k FROM x),
    q AS (SELECT *, sum(exp(-m + k * ln(m) - lgamma(k + 1))) OVER (PARTITION BY symbol, "interval", ts ORDER BY k) AS below FROM k), y AS (SELECT {IDS}, weight,
    count(*) FILTER (WHERE u >= below) AS draws FROM q GROUP BY ALL)
    SELECT {IDS}, weight, draws FROM y WHERE draws > 0""")
)
def weighted_sample(spark, d):
    """Draws with replacement by symbol weight, repeatable."""
    x = H(spark, d).withColumn("weight", F.when(F.col("symbol") == "click", 3.0).otherwise(1.0))
    return dataset.weighted_sample(x).select(*ID, "weight", "draws")


@query(sql(f"""SELECT {IDS}, {r('CASE WHEN sd > 1e-12 THEN (close - m) / sd ELSE 0 END', 'close_z')} FROM candles_60 CROSS JOIN (SELECT avg(close) AS m,
    stddev_samp(close) AS sd FROM candles_60)"""))
def global_zscore(spark, d):
    c = H(spark, d)
    s = c.agg(F.avg("close").alias("m"), F.stddev_samp("close").alias("sd"))
    return c.crossJoin(F.broadcast(s)).select(*ID, F.when(F.col("sd") > 1e-12, (F.col("close") - F.col("m")) / F.col("sd")).otherwise(0.0).alias("close_z"))  # one row


@query(
    sql(f"""SELECT coalesce(x.symbol, y.symbol) AS symbol, coalesce(x.ts, y.ts) AS ts,
        {r('last_value(y.funding_rate IGNORE NULLS) OVER o - last_value(x.funding_rate IGNORE NULLS) OVER o', 'funding_rate_spread', 9)}
    FROM funding x FULL JOIN funding_b y ON x.symbol = y.symbol AND x.ts = y.ts WINDOW o AS (PARTITION BY coalesce(x.symbol, y.symbol) ORDER BY coalesce(x.ts,
    y.ts) ROWS UNBOUNDED PRECEDING)"""),
    digits=9,
)
def exchange_spread(spark, d):
    oi = bars.derivatives(spark, d).withColumn("oi_value", F.col("oi_close"))
    return side_features.exchange(bars.funding(spark, d), bars.funding(spark, d, 6), oi)[0]


@query(sql(f"""WITH a AS (SELECT symbol, ts, oi_close + long_vol AS oi_value, oi_close FROM derivatives) SELECT symbol, ts,
    {r(pct('oi_value', 1, 'symbol') + ' - ' + pct('oi_close', 1, 'symbol'), 'oi_divergence')} FROM a"""))
def interest_divergence(spark, d):
    oi = bars.derivatives(spark, d).withColumn("oi_value", F.col("oi_close") + F.col("long_vol"))
    return side_features.exchange(bars.funding(spark, d), bars.funding(spark, d, 6), oi, oi)[1]


_NAMED = ("click", "view", "purchase", "signup", "error")
_AT = lambda table, alias: f"LEFT JOIN {table} {alias} ON c.symbol = {alias}.symbol AND c.ts = {alias}.ts"
_ASOF = lambda table, alias: f"ASOF LEFT JOIN {table} {alias} ON c.symbol = {alias}.symbol AND c.ts >= {alias}.ts"
_ZZ = lambda x, n, least=None: z(x, n, least, "symbol")
_CORR = f"CASE WHEN count(CASE WHEN ret IS NOT NULL AND lret IS NOT NULL THEN 1 END) OVER {w(24)} = 24 AND var_pop(ret) OVER {w(24)} > 1e-12 AND var_pop(lret) OVER {w(24)} > 1e-12 THEN corr(ret, lret) OVER {w(24)} END"
_digits = lambda name: 9 if name.startswith(("fr_", "funding_")) else 4
#: The features of the sides, as columns of the relations that the SQL joins.
_SIDES = {
    **{f"ob_{x}": f"b.{x}" for x in ("imbalance", "spread_bps", "depth_ratio", "total_depth", "imbalance_change", "spread_change")},
    **{x: f"v.{x}" for x in side_features.DERIVATIVES}, **{x: f"f.{x}" for x in side_features.FUNDING}, **{x: f"l.{x}" for x in side_features.CROSS},
    "fear_greed_index": "g.x", "fear_greed_change": "g.change", "news_sentiment_score": "n.score", "news_volume_zscore": "n.volume", "funding_rate_spread": "e2.spread", "oi_divergence": "oi.change",
}


@query(
    sql(f"""{_ALL}, feat AS (SELECT {IDS}, {', '.join(f'{x} AS {n}' for n, x in _INDICATORS.items())} FROM w4),
  bk AS (SELECT symbol, ts, i AS imbalance, s AS spread_bps, dr AS depth_ratio, td AS total_depth, i - {lag('i', 1, 'symbol')} AS imbalance_change,
  s - {lag('s', 1, 'symbol')} AS spread_change FROM {_OB}),
  dv AS (SELECT symbol, ts, {pct('oi_close', 1, 'symbol')} AS oi_change_pct, {_ZZ('oi_close', 168)} AS oi_zscore, (long_vol - short_vol) / tot AS liq_imbalance,
  {div('tot', roll('avg', 'tot', 24, None, 'symbol'))} AS liq_spike, ratio AS ls_ratio, {_ZZ('ratio', 24)} AS ls_ratio_extreme
    FROM (SELECT *, long_vol + short_vol + 1e-10 AS tot FROM derivatives)),
  fu AS (SELECT symbol, ts, funding_rate AS fr_rate, {_ZZ('funding_rate', 168)} AS fr_rate_zscore,
  funding_rate - {lag('funding_rate', 1, 'symbol')} AS fr_rate_momentum, (mark_price - last_price) / nullif(last_price, 0) AS fr_mark_spot_divergence
  FROM funding),
  rt AS (SELECT *, {pct('close')} AS ret FROM candles_60), mt AS (SELECT "interval", ts, sum(volume) AS market FROM candles_60 GROUP BY ALL),
  lj AS (SELECT rt.symbol, rt."interval", rt.ts, rt.ret, ld.ret AS lret, ld.volume AS lvol, mt.market FROM rt JOIN mt ON rt.ts = mt.ts
  AND rt."interval" = mt."interval" LEFT JOIN (SELECT * FROM rt WHERE symbol = 'click') ld ON rt.ts = ld.ts),
  le AS (SELECT symbol, ts, CASE WHEN symbol <> 'click' THEN lret END AS btc_return_1h, CASE WHEN symbol <> 'click' THEN {_CORR} END AS correlation_to_btc, CASE
  WHEN symbol <> 'click' THEN lvol / nullif(market, 0) END AS btc_dominance_proxy FROM lj),
  fg AS (SELECT ts, value / 100 AS x, value / 100 - lag(value / 100) OVER (ORDER BY ts) AS change FROM fear_greed),
  nw AS (SELECT symbol, ts, (positive - negative) / nullif(t, 0) AS score, {_ZZ('t', 168, 2)} AS volume FROM (SELECT {list(_NAMED)}[CAST(substr(symbol, 2)
  AS INTEGER) % 5 + 1] AS symbol, ts, sum(positive) AS positive, sum(negative) AS negative, CAST(sum(total) AS DOUBLE) AS t FROM news GROUP BY ALL)),
  ex AS (SELECT coalesce(x.symbol, y.symbol) AS symbol, coalesce(x.ts, y.ts) AS ts, last_value(y.funding_rate IGNORE NULLS)
  OVER o - last_value(x.funding_rate IGNORE NULLS) OVER o AS spread
    FROM funding x FULL JOIN funding_b y ON x.symbol = y.symbol AND x.ts = y.ts WINDOW o AS (PARTITION BY coalesce(x.symbol, y.symbol) ORDER BY coalesce(x.ts,
    y.ts) ROWS UNBOUNDED PRECEDING)),
  oi AS (SELECT symbol, ts, {pct('oi_close', 1, 'symbol')} AS change FROM derivatives)
  SELECT c.symbol, c."interval", c.ts, {', '.join(f'coalesce(round(c.{n}, 4), 0) + 0.0 AS {n}' for n in _INDICATORS)},
  {', '.join(f'coalesce(round({x}, {_digits(n)}), 0) + 0.0 AS {n}' for n, x in _SIDES.items())}
  FROM feat c {_ASOF('bk', 'b')} {_AT('dv', 'v')} {_ASOF('fu', 'f')} {_AT('le', 'l')} LEFT
  JOIN fg g ON c.ts = g.ts {_AT('nw', 'n')} {_ASOF('ex', 'e2')} {_AT('oi', 'oi')}""", recursive=True),
    digits=9,
)
def model_features(spark, d):
    """All 66 features of every hourly candle, missing ones 0."""
    c = indicators.compute(H(spark, d))
    oi = bars.derivatives(spark, d).withColumn("oi_value", F.col("oi_close"))
    spread, change = side_features.exchange(bars.funding(spark, d), bars.funding(spark, d, 6), oi)
    named = F.get(F.array(*[F.lit(x) for x in _NAMED]), F.substring("symbol", 2, 9).cast("int") % len(_NAMED))
    news = bars.news(spark, d).withColumn("symbol", named).groupBy("symbol", "ts").agg(*[F.sum(x).alias(x) for x in ("positive", "negative", "neutral", "total")])
    news = side_features.news(news)
    c = c.join(side_features.cross_asset(H(spark, d), "click").select(*ID, *side_features.CROSS), ID, "left")
    sides = [
        (side_features.orderbook(books(spark, d)), side_features.ORDERBOOK, "as_of"),
        (side_features.derivatives(bars.derivatives(spark, d)), side_features.DERIVATIVES, "exact"),
        (side_features.funding(bars.funding(spark, d)), side_features.FUNDING, "as_of"),
        (side_features.sentiment_index(bars.fear_greed(spark, d)), ["fear_greed_index", "fear_greed_change"], "time"),
        (news, ["news_sentiment_score", "news_volume_zscore"], "exact"),
        (spread, ["funding_rate_spread"], "as_of"),
        (change, ["oi_divergence"], "exact"),
    ]
    out = side_features.feature_vector(c, sides)
    return out.select(*ID, *[F.coalesce(F.round(x, _digits(x)), F.lit(0.0)).alias(x) for x in side_features.feature_columns()])
