"""Queries over ensembles, risk, trades and performance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import backtest, ensemble, joins, monitor, risk
from tidemark.plans.market import at, scored
from tidemark.plans.registry import query
from tidemark.plans.sql import CONVICTION, S, pct, r, sql
from tidemark.sources import bars

H = bars.candles
ID = ["symbol", "interval", "ts"]
IDS = 'symbol, "interval", ts'
_P = ("prob_up", "prob_flat", "prob_down")


@query(sql(f"""SELECT {IDS}, direction, {r(CONVICTION, 'conviction')}, {r(f'{CONVICTION} * greatest(prob_up, prob_down) * abs(magnitude) * 100', 'score')}
    FROM predictions"""))
def signal_scores(spark, d):
    p = bars.predictions(spark, d)
    return p.select(*ID, "direction", C.conviction(*_P).alias("conviction"), C.signal_score(*_P, "magnitude").alias("score"))


@query(sql(f"""SELECT {IDS}, direction, {r('score', 'score')}, CAST(rk AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ts
    ORDER BY round(score, 9) DESC, symbol) AS rk FROM (SELECT *, {CONVICTION} * greatest(prob_up, prob_down) * abs(magnitude) * 100 AS score FROM predictions))
    WHERE rk <= 3"""))
def ranked_signals(spark, d):
    """Strongest predictions of each time."""
    p = bars.predictions(spark, d).withColumn("score", C.signal_score(*_P, "magnitude"))
    return ensemble.ranked(p, 3).select(*ID, "direction", "score", "rank")


@query(
    sql(f"""WITH s AS (SELECT *, {CONVICTION} * greatest(prob_up, prob_down) * abs(magnitude) * 100 AS score, count(*) FILTER (WHERE direction = 'DOWN')
        OVER (PARTITION BY ts) AS falls FROM predictions),
    q AS (SELECT *, CASE WHEN falls >= 4 THEN 'HALTED' WHEN falls = 3 THEN 'REDUCED' ELSE 'NORMAL' END AS state, row_number() OVER (PARTITION BY ts
    ORDER BY round(score, 9) DESC, symbol) AS rk FROM s)
    SELECT {IDS}, state, {r('score', 'score')}, CAST(rk AS INTEGER) AS rank FROM q WHERE rk <= CASE state WHEN 'HALTED' THEN 0 WHEN 'REDUCED' THEN 2 ELSE 4 END""")
)
def allowed_signals(spark, d):
    """The strongest signals of each time, fewer or none by the drawdown state (the market's breadth stands for it here)."""
    from pyspark.sql import Window

    p = bars.predictions(spark, d).withColumn("score", C.signal_score(*_P, "magnitude"))
    falls = F.count_if(F.col("direction") == "DOWN").over(Window.partitionBy("ts"))
    p = p.withColumn("state", F.when(falls >= 4, "HALTED").when(falls == 3, "REDUCED").otherwise("NORMAL"))
    return ensemble.ranked(p, 4, state=F.col("state")).select(*ID, "state", "score", "rank")


@query(sql("""SELECT symbol, ts, direction FROM predictions ORDER BY ts DESC, symbol LIMIT 50"""))
def recent_predictions(spark, d):
    return bars.predictions(spark, d).orderBy(F.desc("ts"), "symbol").limit(50).select("symbol", "ts", "direction")


_ENT = "-({0} * ln({0}) + {1} * ln({1}) + {2} * ln({2}))"


@query(
    sql(f"""WITH g AS (SELECT {IDS}, sum(w * prob_up) / sum(w) AS u, sum(w * prob_flat) / sum(w) AS f, sum(w * prob_down) / sum(w) AS dn, sum(w * magnitude)
        / sum(w) AS magnitude, CAST(greatest(count(*) FILTER (WHERE direction = 'UP'), count(*) FILTER (WHERE direction = 'FLAT'), count(*)
        FILTER (WHERE direction = 'DOWN')) AS DOUBLE) / count(*) AS agreement,
      (stddev_pop(prob_up) + stddev_pop(prob_flat) + stddev_pop(prob_down)) / 3 + avg(k / 1000.0) AS uncertainty, count(*) AS models
      FROM (SELECT *, CASE model WHEN 'm0' THEN 1.5 WHEN 'm1' THEN 0.01 ELSE 0.5 END AS w FROM model_predictions WHERE NOT (symbol = 'view' AND model <> 'm0'))
      GROUP BY ALL)
    SELECT {IDS}, {r('u / (u + f + dn + 1e-10)', 'prob_up')}, {r('dn / (u + f + dn + 1e-10)', 'prob_down')}, {r('magnitude', 'magnitude')},
    {r('agreement', 'agreement')}, {r('uncertainty', 'uncertainty')}, models FROM g""")
)
def model_ensemble(spark, d):
    """Models by their Sharpe ratios, with uncertainties of their own; one symbol has a single model."""
    sharpes = spark.createDataFrame([("m0", 1.5), ("m1", -0.3), ("m2", 0.5)], "model string, sharpe double")
    p = bars.model_predictions(spark, d).where("NOT (symbol = 'view' AND model <> 'm0')").withColumn("uncertainty", F.col("k") / 1000)
    return ensemble.combine_models(p, sharpes).select(*ID, "prob_up", "prob_down", "magnitude", "agreement", "uncertainty", "models")


@query(
    sql(f"""WITH s AS (SELECT *, {_ENT.format(*_P)} AS h FROM model_predictions), g AS (SELECT {IDS}, avg(prob_up) AS u, avg(prob_flat) AS f, avg(prob_down)
        AS dn, (stddev_pop(prob_up) + stddev_pop(prob_flat) + stddev_pop(prob_down)) / 3 AS sp, stddev_pop(magnitude) AS sm, avg(h) AS mh FROM s GROUP BY ALL)
    SELECT {IDS}, {r('u', 'prob_up')}, {r('sp', 'std_prob')}, {r('sm', 'std_magnitude')}, {r(_ENT.format('u', 'f', 'dn'), 'entropy')},
    {r(_ENT.format('u', 'f', 'dn') + ' - mh', 'mutual_information')} FROM g""")
)
def sample_uncertainty(spark, d):
    return ensemble.sample_uncertainty(bars.model_predictions(spark, d), ID).select(*ID, "prob_up", "std_prob", "std_magnitude", "entropy", "mutual_information")


@query(
    sql(f"""WITH k AS (SELECT symbol, model, row_number() OVER (PARTITION BY symbol, model ORDER BY ts DESC) AS back, CASE direction WHEN 'UP' THEN 0.0
        WHEN 'FLAT' THEN 1.0 ELSE 2.0 END AS c FROM model_predictions)
    SELECT symbol, x.model AS a, y.model AS b, count(*) AS points, {r('corr(x.c, y.c)', 'r')}, abs(corr(x.c, y.c)) >= 0.7 AND count(*) >= 10 AS is_correlated
    FROM k x JOIN k y USING (symbol, back) WHERE x.model <= y.model GROUP BY 1, 2, 3""")
)
def model_diversity(spark, d):
    """How alike the models' directions are, symbol by symbol."""
    c = F.when(F.col("direction") == "UP", 0.0).when(F.col("direction") == "FLAT", 1.0).otherwise(2.0)
    return joins.pair_correlations(bars.model_predictions(spark, d).withColumn("c", c), "c", "model", 10, within=("symbol",))


_LO = lambda a, b: f"1 / (1 + exp(-(0.6 * ln({a} / (1 - {a})) + 0.4 * ln({b} / (1 - {b})))))"


@query(
    sql(f"""WITH s AS (SELECT symbol, time_bucket(INTERVAL '60 minutes', ts) AS ts, arg_max(struct_pack(u := prob_up, f := prob_flat, dn := prob_down,
        m := magnitude, di := direction), ts) AS b FROM predictions_15 GROUP BY ALL),
    j AS (SELECT p.*, b.m AS bm, b.di AS bd, b.u AS bu, b.f AS bf, b.dn AS bdn, {_LO('prob_up', 'b.u')} AS ou, {_LO('prob_flat', 'b.f')} AS ofl,
    {_LO('prob_down', 'b.dn')} AS od FROM predictions p JOIN s ON p.symbol = s.symbol AND p.ts = s.ts),
    k AS (SELECT *, 0.6 * magnitude + 0.4 * bm AS mg, CASE WHEN direction = bd AND direction = 'FLAT' THEN 'BOTH FLAT'
    WHEN direction = bd THEN 'STRONG ' || direction
        WHEN bd = 'FLAT' THEN 'WEAK ' || direction WHEN direction = 'FLAT' THEN 'TIMING ' || bd WHEN abs(bm) < 0.01 AND NOT abs(magnitude)
        < 0.01 THEN 'PULLBACK ' || direction
        WHEN abs(magnitude) < 0.01 AND NOT abs(bm) < 0.01 THEN 'TIMING ' || bd ELSE 'CONFLICT' END AS agreement_label,
      sqrt({CONVICTION} * greatest(0.0, 1 - {_ENT.format('bu', 'bf', 'bdn')} / ln(3))) AS conviction, ou / (ou + ofl + od) AS cu, ofl / (ou + ofl + od) AS cf,
      od / (ou + ofl + od) AS cd FROM j),
    l AS (SELECT *, CASE WHEN agreement_label LIKE 'STRONG %' THEN 'STRONG' WHEN agreement_label = 'CONFLICT' THEN 'CONFLICT' ELSE 'PARTIAL' END AS agreement
    FROM k),
    s2 AS (SELECT *, greatest(0.0, 1 - {_ENT.format('cu', 'cf', 'cd')} / ln(3)) * greatest(cu, cd) * abs(mg) * 100 * CASE agreement WHEN 'STRONG' THEN 1.5
    WHEN 'PARTIAL' THEN 1 ELSE 0.3 END AS score FROM l)
    SELECT symbol, ts, {r('cu', 'prob_up')}, {r('cd', 'prob_down')}, {r('mg', 'magnitude')}, agreement, agreement_label, {r('conviction', 'conviction')},
    {r('score', 'score')},
      CAST(row_number() OVER (PARTITION BY ts ORDER BY round(score, 9) DESC, symbol) AS INTEGER) AS rank FROM s2""")
)
def timeframe_blend(spark, d):
    q = bars.predictions(spark, d, 15).withColumn("at", F.col("ts")).withColumn("ts", F.window("ts", "60 minutes")["start"])
    blend = ensemble.ranked(ensemble.combine_timeframes(bars.predictions(spark, d), q), 10)
    return blend.select("symbol", "ts", "prob_up", "prob_down", "magnitude", "agreement", "agreement_label", "conviction", "score", "rank")


@query(sql("""SELECT ts, count(*) FILTER (WHERE direction = 'UP') AS n_up, count(*) FILTER (WHERE direction = 'DOWN') AS n_down, count(*)
    FILTER (WHERE direction = 'FLAT') AS n_flat FROM predictions GROUP BY 1"""))
def market_breadth(spark, d):
    return ensemble.breadth(bars.predictions(spark, d), ["ts"])


@query(
    sql(f"""WITH RECURSIVE x AS (SELECT symbol, ts, CAST(k AS DOUBLE) AS v, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM predictions),
        f AS (SELECT symbol, i, v AS s FROM x WHERE i = 1 UNION ALL SELECT x.symbol, x.i, 0.95 * f.s + 0.05 * x.v FROM f JOIN x ON x.symbol = f.symbol
        AND x.i = f.i + 1)
    SELECT symbol, count(*) AS n, {r('arg_max(s, i)', 'score')} FROM f GROUP BY 1""".replace("WITH RECURSIVE", "WITH", 1), recursive=True)
)
def decayed_performance(spark, d):
    return ensemble.decayed_performance(bars.predictions(spark, d).withColumn("value", F.col("k")), ["symbol"])


@query(sql(f"""SELECT symbol, "interval", 'm' || arg_max(m, (round(s, 9), 'm' || m)) AS model, {r('max(s)', 'score')} FROM (SELECT symbol, "interval",
    substr(model, 2) AS m, round(avg(magnitude), 9) AS s FROM model_predictions GROUP BY ALL HAVING count(*) >= 10) GROUP BY 1, 2"""))
def best_models(spark, d):
    p = bars.model_predictions(spark, d).groupBy("symbol", F.col("interval").alias("regime"), "model").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("magnitude"), 9).alias("score"))
    return ensemble.best_models(p).withColumnRenamed("regime", "interval")


@query(sql(f"""SELECT symbol, {r('acc', 'acc')}, {r('CASE WHEN acc + 0.5 > 0 THEN acc / (acc + 0.5) ELSE 0.6 END', 'w_primary')} FROM (SELECT symbol,
    avg(CAST(actual_direction = direction AS DOUBLE)) AS acc FROM scored GROUP BY 1)"""))
def adaptive_timeframe_weights(spark, d):
    s = scored(spark, d).where("scored_at IS NOT NULL").groupBy("symbol").agg(F.avg(F.col("was_correct").cast("double")).alias("acc"))
    return s.select("symbol", "acc", ensemble.adaptive_weights(F.col("acc"), F.lit(0.5))[0].alias("w_primary"))


@query(
    sql(f"""WITH s AS (SELECT *, k / 100.0 AS win, (k + 1) / 1000.0 AS aw, (100 - k) / 1000.0 AS al, {CONVICTION} AS cv FROM predictions), f AS (SELECT *,
        0.5 * (win * (aw / al) - (1 - win)) / (aw / al) AS kf FROM s)
    SELECT {IDS}, {r('10000 * CASE WHEN al > 0 AND win > 0 AND kf > 0 THEN least(0.1, greatest(0.01, kf)) * cv ELSE 0.01 END', 'kelly')},
    {r('10000 * CASE WHEN k > 0 THEN least(0.1, 0.01 / (2 * (k / 1000.0))) ELSE 0.02 END', 'by_volatility')}, CAST(500 AS DOUBLE) AS fixed FROM f""")
)
def position_sizes(spark, d):
    k = F.col("k")
    p = bars.predictions(spark, d)
    return p.select(*ID, risk.kelly(F.lit(10_000.0), k / 100, (k + 1) / 1000, (100 - k) / 1000, C.conviction(*_P)).alias("kelly"), risk.by_volatility(F.lit(10_000.0), k / 1000).alias("by_volatility"), risk.fixed(F.lit(10_000.0)).alias("fixed"))


@query(
    sql(f"""SELECT {IDS}, {r("close - CASE WHEN direction = 'UP' THEN 1 ELSE -1 END * 2 * (high - low)", 'stop', 9)},
        {r("close + CASE WHEN direction = 'UP' THEN 1 ELSE -1 END * 3 * (high - low)", 'take', 9)},
        {r('2 * close * 0.0011 + close * 0.0001 * k / 8', 'cost', 9)} FROM candles_60 JOIN predictions USING (symbol, "interval", ts)"""),
    digits=9,
)
def stops_and_costs(spark, d):
    x = H(spark, d).join(bars.predictions(spark, d), ID).withColumn("side", F.when(F.col("direction") == "UP", "LONG").otherwise("SHORT"))
    stop, take = risk.stop_prices(F.col("close"), F.col("high") - F.col("low"), F.col("side"))
    return x.select(*ID, stop.alias("stop"), take.alias("take"), risk.round_trip_cost(F.col("close"), F.col("k"), funding=0.0001).alias("cost"))


@query(
    sql(f"""WITH x AS (SELECT symbol, ts, {pct('close')} AS ret FROM candles_60), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC)
        AS back, count(*) OVER (PARTITION BY symbol) AS n FROM x WHERE ret IS NOT NULL),
    p AS (SELECT a.symbol AS a, b.symbol AS b FROM k a JOIN k b ON a.back = b.back AND a.symbol <> b.symbol AND a.n >= 24 AND b.n >= 24 GROUP BY 1, 2
    HAVING abs(corr(a.ret, b.ret)) >= 0.02 AND count(*) >= 10),
    c AS (SELECT symbol, arg_max(close, ts) * 10 AS notional FROM candles_60 GROUP BY 1), o AS (SELECT CAST(1500 * count(*) AS DOUBLE) AS open_notional FROM c
    WHERE symbol IN ('click', 'view')),
    q AS (SELECT c.symbol, c.notional, o.open_notional, (SELECT count(*) FROM p WHERE p.a = c.symbol AND p.b IN (SELECT symbol FROM c WHERE symbol IN ('click',
    'view'))) AS n_correlated FROM c CROSS JOIN o),
    t AS (SELECT *, CASE WHEN notional > 1000 THEN 'single' WHEN open_notional + notional > 5000 THEN 'total' WHEN n_correlated >= 2 THEN 'correlated'
    END AS reason FROM q)
    SELECT symbol, {r('notional', 'notional')}, open_notional, n_correlated, reason, reason IS NULL AS may_open FROM t""")
)
def position_limits(spark, d):
    """Candidates against open positions and correlated symbols, each pair over its own common tail."""
    x = H(spark, d).withColumn("ret", C.pct("close"))
    pairs = joins.pair_correlations(x, high=0.02, tail="pair")
    last = joins.latest(x, 1)
    return risk.position_limits(last.select("symbol", (F.col("close") * 10).alias("notional")), last.where("symbol IN ('click', 'view')").select("symbol", F.lit(1500.0).alias("notional")), pairs, 10_000.0, most_correlated=2)


@query(
    sql(f"""WITH x AS (SELECT *, {CONVICTION} AS cv FROM predictions), y AS (SELECT *, CASE WHEN direction = 'UP' AND prob_up >= 0.45 THEN 'LONG'
        WHEN direction = 'DOWN' AND prob_down >= 0.45 THEN 'SHORT' END AS action, cv * abs(magnitude) AS strength FROM x WHERE cv >= 0.1 AND abs(magnitude)
        >= 0.002)
    SELECT {IDS}, action, {r('strength', 'strength')} FROM (SELECT *, row_number() OVER (PARTITION BY "interval", ts ORDER BY strength DESC, symbol) AS rk
    FROM y WHERE action IS NOT NULL) WHERE rk <= 10""")
)
def entry_signals(spark, d):
    return entries(spark, d).select(*ID, "action", "strength")


def entries(spark, d):
    p = bars.predictions(spark, d).withColumn("conviction", C.conviction(*_P))
    return backtest.signals(p, conviction_least=0.1, most=10)


_NX = f"""sig AS (SELECT symbol, "interval", ts, CASE WHEN direction = 'UP' AND prob_up >= 0.45 THEN 'LONG' WHEN direction = 'DOWN'
    AND prob_down >= 0.45 THEN 'SHORT' END AS action FROM predictions WHERE {CONVICTION} >= 0.1 AND abs(magnitude) >= 0.002),
  b AS (SELECT *, row_number() OVER ({S}) AS n, count(*) OVER (PARTITION BY symbol, "interval") AS total FROM candles_60), s AS (SELECT sig.*, b.n, b.total,
  b.close AS p FROM sig JOIN b USING (symbol, "interval", ts) WHERE action IS NOT NULL AND b.n < b.total),
  h AS (SELECT s.symbol, s."interval", s.ts, min(x.n) AS hit FROM s JOIN b x ON x.symbol = s.symbol AND x."interval" = s."interval" AND x.n > s.n
  AND x.n <= s.n + 24 WHERE CASE WHEN action = 'LONG' THEN x.low <= p * 0.98 OR x.high >= p * 1.03 ELSE x.high >= p * 1.02 OR x.low <= p * 0.97 END
  GROUP BY ALL),
  t AS (SELECT s.*, h.hit, least(s.n + 24, s.total) AS last, coalesce(h.hit, least(s.n + 24, s.total)) AS xn FROM s LEFT JOIN h USING (symbol, "interval", ts)),
  trd AS (SELECT t.symbol, t."interval", t.ts, t.action, t.p AS entry_price, x.ts AS exit_ts, CASE WHEN hit IS NULL THEN x.close WHEN action = 'LONG' THEN CASE
  WHEN x.low <= p * 0.98 THEN p * 0.98 ELSE p * 1.03 END ELSE CASE WHEN x.high >= p * 1.02 THEN p * 1.02 ELSE p * 0.97 END END AS exit_price,
    CASE WHEN hit IS NULL THEN CASE WHEN xn - t.n = 24 THEN 'time' ELSE 'end_of_backtest' END WHEN (action = 'LONG' AND x.low <= p * 0.98) OR (action = 'SHORT'
    AND x.high >= p * 1.02) THEN 'stop_loss' ELSE 'take_profit' END AS exit_reason, xn - t.n AS bars_held FROM t JOIN b x ON x.symbol = t.symbol
    AND x."interval" = t."interval" AND x.n = xn)"""


def closed(spark, d):
    return backtest.exits(H(spark, d), entries(spark, d))


@query(sql(f"""WITH {_NX} SELECT {IDS}, action, {r('entry_price', 'entry_price')}, exit_ts, {r('exit_price', 'exit_price')}, exit_reason, bars_held FROM trd"""))
def trade_exits(spark, d):
    """Stop, target or time exit of every signal."""
    return closed(spark, d).drop("path")


_RV = f"""{_NX}, o AS (SELECT a.symbol, a."interval", a.ts, min(z.ts) AS ots FROM trd a JOIN sig z ON z.symbol = a.symbol AND z."interval" = a."interval"
    AND z.ts > a.ts AND z.action <> a.action GROUP BY ALL),
  fin AS (SELECT t.symbol, t."interval", t.ts, t.action, t.entry_price, CASE WHEN cut THEN ots ELSE exit_ts END AS exit_ts, CASE WHEN cut THEN z.close
  ELSE exit_price END AS exit_price, CASE WHEN cut THEN 'reversal' ELSE exit_reason END AS exit_reason
    FROM (SELECT trd.*, o.ots, coalesce(o.ots < exit_ts OR (o.ots = exit_ts AND exit_reason IN ('time', 'end_of_backtest')), false) AS cut FROM trd LEFT
    JOIN o USING (symbol, "interval", ts)) t
    LEFT JOIN b z ON z.symbol = t.symbol AND z."interval" = t."interval" AND z.ts = t.ots)"""
# Of each series' trades in time order, the first, and then each that begins when the one before it is over; with its profit.
_BK = f"""{_RV}, ch AS (SELECT *, row_number() OVER ({S}) AS i FROM fin),
  gr AS (SELECT symbol, "interval", i, true AS keep, exit_ts AS free FROM ch WHERE i = 1 UNION ALL
    SELECT ch.symbol, ch."interval", ch.i, ch.ts >= gr.free, CASE WHEN ch.ts >= gr.free THEN ch.exit_ts ELSE gr.free END FROM gr
    JOIN ch ON ch.symbol = gr.symbol AND ch."interval" = gr."interval" AND ch.i = gr.i + 1),
  bk AS (SELECT ch.*, 1000 * CASE WHEN action = 'LONG' THEN 1 ELSE -1 END * (exit_price - entry_price) / nullif(entry_price, 0) - 2.2 AS net_pnl FROM ch
  JOIN gr USING (symbol, "interval", i) WHERE keep)"""
_EQ = f"""{_BK}, mk AS (SELECT b."interval", b.ts, sum(1000 * CASE WHEN action = 'LONG' THEN 1 ELSE -1 END * (b.close - entry_price) / nullif(entry_price, 0))
    AS unrealized FROM bk JOIN b ON b.symbol = bk.symbol AND b."interval" = bk."interval" AND b.ts > bk.ts AND b.ts < bk.exit_ts GROUP BY ALL),
  cl AS (SELECT "interval", exit_ts AS ts, sum(net_pnl) AS net FROM bk GROUP BY ALL),
  e1 AS (SELECT "interval", ts, sum(coalesce(net, 0)) OVER (PARTITION BY "interval" ORDER BY ts) AS realized, coalesce(unrealized, 0) AS unrealized
  FROM (SELECT DISTINCT "interval", ts FROM candles_60) LEFT JOIN mk USING ("interval", ts) LEFT JOIN cl USING ("interval", ts)),
  eq AS (SELECT *, round(10000 + realized + unrealized, 6) AS equity FROM e1)"""


def _performance(curve: str, by: str, year: float = 8766) -> str:
    """Expressions that end in `perf`: figures of each run of a curve, with so many periods a year."""
    w = f"(PARTITION BY {by} ORDER BY ts)"
    return f"""pk AS (SELECT *, max(equity) OVER {w} AS peak, (equity - lag(equity) OVER {w}) / nullif(lag(equity) OVER {w}, 0) AS ret FROM {curve}),
  dd AS (SELECT *, (equity - peak) / nullif(peak, 0) AS dr FROM pk), ru AS (SELECT *, sum(CASE WHEN dr < 0 THEN 0 ELSE 1 END) OVER {w} AS g FROM dd),
  lo AS (SELECT {by}, max(run) AS longest_drawdown FROM (SELECT {by}, g, count(*) FILTER (WHERE dr < 0) AS run FROM ru GROUP BY ALL) GROUP BY ALL),
  st AS (SELECT {by}, count(*) AS periods, arg_max(equity, ts) / arg_min(equity, ts) - 1 AS total_return, CASE WHEN stddev_samp(ret) > 1e-12 THEN avg(ret)
  / stddev_samp(ret) * sqrt({year}) ELSE 0 END AS sharpe,
    CASE WHEN (stddev_samp(ret) FILTER (WHERE ret < 0)) > 1e-12 THEN avg(ret) / (stddev_samp(ret) FILTER (WHERE ret < 0)) * sqrt({year}) ELSE 0 END AS sortino,
    min(dr) AS max_drawdown FROM dd GROUP BY ALL),
  an AS (SELECT *, CASE WHEN periods > 1 AND total_return > -1 THEN pow(1 + total_return, CAST({year} AS DOUBLE) / periods) - 1 END AS annual_return FROM st),
  perf AS (SELECT *, annual_return / nullif(abs(max_drawdown), 0) AS calmar FROM an JOIN lo USING ({by}))"""


@query(sql(f"""WITH {_RV} SELECT {IDS}, exit_ts, exit_reason FROM fin"""))
def trade_reversals(spark, d):
    return backtest.exits(H(spark, d), entries(spark, d), reverse=True).select(*ID, "exit_ts", "exit_reason")


def book(spark, d):
    return backtest.profit(backtest.one_at_a_time(backtest.exits(H(spark, d), entries(spark, d), reverse=True)))


@query(sql(f"""WITH {_BK} SELECT {IDS}, action, exit_ts, exit_reason, {r('net_pnl', 'net_pnl')} FROM bk""", recursive=True))
def backtest_trades(spark, d):
    """One open trade a series, with profit after costs."""
    return book(spark, d).select(*ID, "action", "exit_ts", "exit_reason", "net_pnl")


@query(sql(f"""WITH {_EQ} SELECT "interval", ts, {r('realized', 'realized')}, {r('unrealized', 'unrealized')}, {r('equity', 'equity')} FROM eq""", recursive=True))
def backtest_equity(spark, d):
    return backtest.equity_curve(book(spark, d), H(spark, d))


_FIGURES = ["total_return", "sharpe", "sortino", "max_drawdown", "annual_return", "calmar"]


@query(sql(f"""WITH {_EQ}, {_performance('eq', '"interval"')} SELECT "interval", periods, longest_drawdown, {', '.join(r(c, c, 4) for c in _FIGURES)} FROM perf""", recursive=True), digits=4)
def backtest_performance(spark, d):
    return backtest.performance(backtest.equity_curve(book(spark, d), H(spark, d)), ["interval"])


@query(
    sql(f"""WITH al AS (SELECT 'all' AS run_id, ts, equity FROM equity), {_performance('al', 'run_id', 365.25)}
    SELECT run_id, periods, {r('total_return', 'total_return')}, {r('sharpe', 'sharpe', 4)}, {r('sortino', 'sortino', 4)}, {r('max_drawdown', 'max_drawdown')},
    longest_drawdown, {r('annual_return', 'annual_return')} FROM perf""")
)
def performance_report(spark, d):
    e = bars.equity(spark, d).withColumn("run_id", F.lit("all"))
    p = backtest.performance(e, ["run_id"], 365.25)
    return p.select("run_id", "periods", "total_return", F.round("sharpe", 4).alias("sharpe"), F.round("sortino", 4).alias("sortino"), "max_drawdown", "longest_drawdown", "annual_return")


@query(
    sql(f"""SELECT side, count(*) AS trades, {r('avg(CAST(net_pnl > 0 AS DOUBLE))', 'win_rate')},
        {r('avg(net_pnl / notional) FILTER (WHERE net_pnl > 0)', 'avg_win')}, {r('avg(net_pnl / notional) FILTER (WHERE NOT net_pnl > 0)', 'avg_loss')},
        {r('(sum(net_pnl) FILTER (WHERE net_pnl > 0)) / nullif(sum(-net_pnl) FILTER (WHERE NOT net_pnl > 0), 0)', 'profit_factor')},
    {r('round(sum(costs), 2)', 'fees')}, {r("avg(date_diff('day', CAST(entry AS DATE), CAST(exit AS DATE)) * 24.0)", 'avg_hours')} FROM trades GROUP BY 1""")
)
def trade_statistics(spark, d):
    return backtest.trade_statistics(bars.trades(spark, d), ["side"]).withColumn("fees", F.round("fees", 2))


@query(
    sql(f"""WITH ret AS (SELECT symbol, ts, {pct('close', 1, 'symbol')} / 1000 AS ret FROM candles_user), b AS (SELECT ts, avg(ret) AS bench FROM ret WHERE ret IS NOT NULL GROUP BY ts)
    SELECT symbol, {r('exp(sum(ln(1 + bench))) - 1', 'benchmark_return')},
    {r('CASE WHEN stddev_pop(ret - bench) > 1e-12 THEN avg(ret - bench) / stddev_pop(ret - bench) * sqrt(365.25) ELSE 0 END', 'information_ratio')} FROM ret
    JOIN b USING (ts) WHERE ret IS NOT NULL GROUP BY 1""")
)
def benchmark_comparison(spark, d):
    """Users' day returns against the mean of all; a day after a close of 0 has no return."""
    x = bars.user_candles(spark, d).select("symbol", "ts", (C.pct("close", 1, ("symbol",)) / 1000).alias("ret")).where("ret IS NOT NULL")
    return backtest.against_benchmark(x, x.groupBy("ts").agg(F.avg("ret").alias("bench")), ["symbol"], 365.25)


@query(sql("""SELECT symbol, CAST(fold AS BIGINT) AS fold, count(*) AS bars, min(ts) AS first_ts FROM (SELECT symbol, ts, floor((n - 1 - 100)
    / greatest(floor((total - 100) / 4), 1)) AS fold FROM (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n, count(*)
    OVER (PARTITION BY symbol) AS total FROM candles_60)) WHERE fold BETWEEN 1 AND 3 GROUP BY 1, 2"""))
def backtest_folds(spark, d):
    return backtest.folds(H(spark, d), 3, 100).groupBy("symbol", "fold").agg(F.count(F.lit(1)).alias("bars"), F.min("ts").alias("first_ts"))


@query(
    sql(f"""WITH {_EQ}, n AS (SELECT "interval", ts, row_number() OVER (PARTITION BY symbol, "interval" ORDER BY ts) AS n, count(*) OVER (PARTITION BY symbol,
        "interval") AS total FROM candles_60),
    fo AS (SELECT DISTINCT "interval", ts, CAST(floor((n - 1 - 100) / greatest(floor((total - 100) / 4), 1)) AS BIGINT) AS fold FROM n), ef AS (SELECT eq.*,
    fold FROM eq JOIN fo USING ("interval", ts) WHERE fold BETWEEN 1 AND 3), {_performance('ef', '"interval", fold')}
    SELECT "interval", count(*) AS folds, {r('avg(sharpe)', 'sharpe', 4)}, {r('avg(total_return)', 'total_return', 4)},
    {r('min(max_drawdown)', 'max_drawdown', 4)}, count(*) FILTER (WHERE sharpe < -1) AS blocked_folds FROM perf GROUP BY 1""", recursive=True),
    digits=4,
)
def walk_forward_summary(spark, d):
    """Performance per fold and its mean, with what would block a deployment."""
    b = backtest.folds(H(spark, d), 3, 100)
    e = backtest.equity_curve(book(spark, d), H(spark, d)).join(b.select("interval", "ts", "fold").distinct(), ["interval", "ts"])
    p = backtest.performance(e, ["interval", "fold"])
    bad = backtest.blocked(p).groupBy("interval").agg(F.count(F.lit(1)).alias("blocked_folds"))
    g = p.groupBy("interval").agg(F.count(F.lit(1)).alias("folds"), F.avg("sharpe").alias("sharpe"), F.avg("total_return").alias("total_return"), F.min("max_drawdown").alias("max_drawdown"))
    return g.join(bad, "interval", "left").withColumn("blocked_folds", F.coalesce("blocked_folds", F.lit(0).cast("long")))


MACHINE = sql(
    f"""WITH curve AS (SELECT symbol AS portfolio, ts, (100 + total) * CASE WHEN last < 15 THEN 0.8 WHEN last < 35 THEN 0.93 ELSE 1 END AS equity, row_number()
        OVER (PARTITION BY symbol ORDER BY ts) AS i
      FROM (SELECT symbol, ts, close AS last, sum(close) OVER (PARTITION BY symbol ORDER BY ts) / 100 AS total FROM candles_user)),
    m AS (SELECT DISTINCT portfolio, CAST(0 AS BIGINT) AS i, CAST(NULL AS TIMESTAMP) AS ts, 0.0::DOUBLE AS equity, 'NORMAL' AS state, 0.0::DOUBLE AS peak,
    0.0::DOUBLE AS drawdown, 0.0::DOUBLE AS halted, CAST(0 AS BIGINT) AS periods FROM curve
      UNION ALL SELECT portfolio, i, ts, equity, now, peak, drawdown, CASE WHEN now = 'HALTED' AND before <> 'HALTED' THEN equity ELSE halted END, CASE
      WHEN now = before THEN periods + 1 ELSE 0 END
      FROM (SELECT *, CASE WHEN before = 'HALTED' THEN CASE WHEN halted > 0 AND (equity - halted) / halted * 100 >= 5 THEN 'RECOVERING' ELSE 'HALTED' END
          WHEN before = 'RECOVERING' THEN CASE WHEN 100 * drawdown < 5 THEN 'NORMAL' WHEN 100 * drawdown >= 10 THEN 'HALTED' ELSE 'RECOVERING' END
          WHEN 100 * drawdown >= 10 THEN 'HALTED' WHEN 100 * drawdown >= 5 THEN 'REDUCED' ELSE 'NORMAL' END AS now
        FROM (SELECT c.portfolio, c.i, c.ts, c.equity, m.state AS before, greatest(m.peak, c.equity) AS peak, (greatest(m.peak, c.equity) - c.equity)
        / greatest(m.peak, c.equity) AS drawdown, m.halted, m.periods
          FROM m JOIN curve c ON c.portfolio = m.portfolio AND c.i = m.i + 1)))
    SELECT portfolio, ts, equity, state, {r('drawdown', 'drawdown')},
    {r("CASE state WHEN 'NORMAL' THEN 1 WHEN 'REDUCED' THEN 0.5 WHEN 'HALTED' THEN 0 ELSE 0.5 + 0.5 * least(1, periods / 24) END", 'multiplier')} FROM m
    WHERE i > 0""",
    recursive=True,
)


def dipping_equity(spark, d):
    """Curves of all users that fall when the day's last value is small."""
    e = bars.user_candles(spark, d).select(F.col("symbol").alias("portfolio"), "ts", F.col("close").alias("last"), (F.sum("close").over(C.so_far("symbol")) / 100).alias("total"))
    return e.select("portfolio", "ts", ((100 + F.col("total")) * F.when(F.col("last") < 15, 0.8).when(F.col("last") < 35, 0.93).otherwise(1.0)).alias("equity"))


@query(MACHINE.replace("ts, equity, state", f"ts, {r('equity', 'equity')}, state"))
def drawdown_machine(spark, d):
    return risk.drawdown_states(dipping_equity(spark, d))


@query(
    sql(f"""WITH q AS (SELECT ts, equity, max(equity) OVER (ORDER BY ts) AS peak FROM equity), g AS (SELECT *, sum(CASE WHEN equity < peak THEN 0 ELSE 1 END)
        OVER (ORDER BY ts) AS g FROM q)
    SELECT ts, {r('(equity - peak) / peak', 'drawdown', 9)}, CAST(sum(CASE WHEN equity < peak THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY ts) AS BIGINT)
    AS run FROM g"""),
    digits=9,
)
def drawdown_series(spark, d):
    return risk.drawdown_series(bars.equity(spark, d).withColumn("one", F.lit(1)), ["one"]).select("ts", "drawdown", "run")


_KL = "({0} * ln({0} / {1}))"


@query(
    sql(f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY "interval" ORDER BY ts DESC, symbol) AS b FROM predictions), p AS (SELECT "interval", count(*)
        AS n, {', '.join(f"greatest(count(*) FILTER (WHERE direction = '{c}') / count(*), 1e-10) AS {c.lower()}" for c in ('UP', 'FLAT', 'DOWN'))} FROM k
        WHERE b <= 200 GROUP BY 1),
    q AS (SELECT "interval", count(*) AS n, {', '.join(f"greatest(count(*) FILTER (WHERE direction = '{c}') / count(*), 1e-10) AS {c.lower()}" for c in ('UP', 'FLAT', 'DOWN'))}
    FROM predictions WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1),
    z AS (SELECT "interval", p.n, {' + '.join(_KL.format(f'(p.{c} / (p.up + p.flat + p.down))', f'(q.{c} / (q.up + q.flat + q.down))') for c in ('up', 'flat', 'down'))}
    AS kl FROM p JOIN q USING ("interval")) SELECT "interval", n, {r('kl', 'kl', 4)}, kl > 0.1 AS is_drift FROM z"""),
    digits=4,
)
def prediction_drift(spark, d):
    p = bars.predictions(spark, d)
    return monitor.kl_drift(monitor.newest(p, 200, ["interval"]), p.where(F.col("ts") < at("2024-01-10")), ["interval"])


@query(
    sql(f"""WITH c AS (SELECT floor(p * 10) AS b, count(*) AS n, avg(p) AS conf, avg(ok) AS acc FROM (SELECT CASE WHEN k >= 90 THEN 1.0 ELSE greatest(prob_up,
        prob_flat, prob_down) END AS p, CAST(actual_direction = direction AS DOUBLE) AS ok FROM scored)
      WHERE p < 1 GROUP BY 1), t AS (SELECT CAST(sum(n) AS BIGINT) AS n, sum(n * abs(conf - acc)) / sum(n) AS ece FROM c)
    SELECT n, {r('ece', 'ece')}, ece > 0.15 AS is_degraded FROM t""")
)
def calibration_error(spark, d):
    """Some predictions are certain: they are in no bin."""
    s = scored(spark, d).where("scored_at IS NOT NULL")
    return monitor.calibration(s.withColumn("prob_up", F.when(F.col("k") >= 90, 1.0).otherwise(F.col("prob_up"))))


_PNL = "CASE WHEN direction = 'UP' THEN actual_magnitude WHEN direction = 'DOWN' THEN -actual_magnitude ELSE 0 END"


@query(
    sql(f"""WITH a AS (SELECT CASE WHEN symbol IN ('click', 'view') THEN 'production' ELSE 'shadow' END AS arm, ts, {_PNL} AS pnl FROM scored),
        g AS (SELECT count(*) FILTER (WHERE arm = 'shadow') AS n, date_diff('second', min(ts), max(ts)) / 86400.0 AS days, (avg(pnl)
        FILTER (WHERE arm = 'production')) / (stddev_samp(pnl) FILTER (WHERE arm = 'production')) * sqrt(8760) AS ps, (avg(pnl) FILTER (WHERE arm = 'shadow'))
        / (stddev_samp(pnl) FILTER (WHERE arm = 'shadow')) * sqrt(8760) AS ss FROM a)
    SELECT n, {r('days', 'days')}, {r('ps', 'production_sharpe')}, {r('ss', 'shadow_sharpe')}, CASE WHEN n < 100 THEN 'samples' WHEN days < 7 THEN 'days'
    WHEN ss - ps < 0.1 THEN 'edge' ELSE 'promote' END AS reason, n >= 100 AND days >= 7 AND ss - ps >= 0.1 AS promote FROM g""")
)
def ab_evaluation(spark, d):
    x = F.col("actual_magnitude")
    s = scored(spark, d).where("scored_at IS NOT NULL").select(F.when(F.col("symbol").isin("click", "view"), "production").otherwise("shadow").alias("arm"), "ts", F.when(F.col("direction") == "UP", x).when(F.col("direction") == "DOWN", -x).otherwise(0.0).alias("pnl"))
    return monitor.ab_test(s)


_LOSS = """avg(-ln(CASE actual_direction WHEN 'UP' THEN m.prob_up WHEN 'FLAT' THEN m.prob_flat ELSE m.prob_down END)) + avg(CASE
    WHEN abs(m.magnitude - actual_magnitude) <= 1 THEN 0.5 * (m.magnitude - actual_magnitude) * (m.magnitude - actual_magnitude)
    ELSE abs(m.magnitude - actual_magnitude) - 0.5 END)"""


@query(
    sql(f"""SELECT model, count(*) AS n, {r('avg(CAST(m.direction = actual_direction AS DOUBLE))', 'accuracy')},
        {r('avg(abs(m.magnitude - actual_magnitude))', 'mae')}, {r(_LOSS, 'loss')} FROM model_predictions m JOIN scored s ON m.symbol = s.symbol AND m.ts = s.ts
        GROUP BY 1""")
)
def model_evaluation(spark, d):
    return monitor.model_eval(joins.outcomes(bars.model_predictions(spark, d), H(spark, d), 0.5).where("scored_at IS NOT NULL"), ["model"])


@query(
    sql(f"""WITH v AS (SELECT model, {_LOSS} AS loss FROM model_predictions m JOIN scored s ON m.symbol = s.symbol AND m.ts = s.ts GROUP BY 1),
        g AS (SELECT max(loss) FILTER (WHERE model = 'm1') AS n, max(loss) FILTER (WHERE model = 'm0') AS o FROM v) SELECT {r('n', 'new_loss')},
        {r('o', 'old_loss')}, n <= 1.05 * o AS deploy FROM g""")
)
def deploy_gate(spark, d):
    e = monitor.model_eval(joins.outcomes(bars.model_predictions(spark, d), H(spark, d), 0.5).where("scored_at IS NOT NULL"), ["model"])
    return monitor.deploy_gate(e, "m1", "m0")


_T = [0.25, 0.5, 1.0, 1.5, 2.0, 4.0, 8.0]


@query(
    sql(f"""WITH t AS (SELECT unnest([{', '.join(map(str, _T))}])::DOUBLE AS t), x AS (SELECT t, pow(prob_up, 1 / t) AS a, pow(prob_flat, 1 / t) AS b,
        pow(prob_down, 1 / t) AS c, actual_direction AS y FROM scored CROSS JOIN t), g AS (SELECT t, avg(-ln(CASE y WHEN 'UP' THEN a WHEN 'FLAT' THEN b ELSE c
        END / (a + b + c))) AS nll FROM x GROUP BY 1)
    SELECT t AS temperature, {r('nll', 'nll')} FROM g ORDER BY round(nll, 9), t LIMIT 1""")
)
def temperature_scaling(spark, d):
    return monitor.temperature(scored(spark, d).where("scored_at IS NOT NULL"), _T)


@query(
    sql(f"""WITH t AS (SELECT exp(ln(0.01) + unnest(range(4001)) * ln(10000) / 4000) AS t UNION ALL SELECT 1), x AS (SELECT CASE actual_direction
        WHEN 'UP' THEN 0 WHEN 'FLAT' THEN 1 ELSE 2 END AS y, ln(prob_up) AS a, ln(prob_flat) AS b, ln(prob_down) AS c FROM scored),
    k AS (SELECT y, a, b, c, count(*) AS n FROM x GROUP BY ALL), g AS (SELECT t, sum(n * (ln(exp(a / t) + exp(b / t) + exp(c / t)) - CASE y WHEN 0 THEN a
    WHEN 1 THEN b ELSE c END / t)) / sum(n) AS nll FROM k CROSS JOIN t GROUP BY 1)
    SELECT {r('min(nll)', 'nll', 4)}, {r('(SELECT any_value(nll) FROM g WHERE t = 1) - min(nll)', 'gain', 4)} FROM g"""),
    digits=4,
)
def fitted_temperature(spark, d):
    """What the best temperature gives over all scored rows, and how much better than 1 that is."""
    x = scored(spark, d).where("scored_at IS NOT NULL")
    t, nll = monitor.fitted_temperature(x)
    plain = monitor.temperature(x, [1.0]).select(F.lit(nll).alias("nll"), (F.col("nll") - nll).alias("gain"))
    return plain


_PERF = """SELECT symbol, model, count(*) AS n, round(avg(magnitude), 9) AS score FROM model_predictions GROUP BY ALL"""


def model_performance(spark, d):
    p = bars.model_predictions(spark, d)
    return p.groupBy("symbol", F.col("interval").alias("regime"), "model").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("magnitude"), 9).alias("score"))


@query(sql(f"""SELECT model, {r('avg(score)', 'mean_score')}, {r('stddev_pop(score)', 'std_score')}, CAST(sum(n) AS BIGINT) AS records FROM ({_PERF}) GROUP BY 1"""))
def model_performance_summary(spark, d):
    return ensemble.performance_summary(model_performance(spark, d))


@query(
    sql(f"""WITH p AS ({_PERF}), b AS (SELECT symbol, arg_max(model, (score, model)) AS model FROM p WHERE n >= 300 GROUP BY 1), t AS (SELECT arg_max(model,
        (round(m, 9), model)) AS top FROM (SELECT model, avg(score) AS m FROM p GROUP BY 1))
    SELECT s.symbol, coalesce(b.model, t.top) AS model FROM (SELECT DISTINCT symbol FROM p) s LEFT JOIN b USING (symbol) CROSS JOIN t""")
)
def selected_models(spark, d):
    return ensemble.selected_models(model_performance(spark, d), 300).select("symbol", "model")
