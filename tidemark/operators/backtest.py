"""Signals to trades, equity and performance, for many runs and symbols at once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import KEY, series
from tidemark.operators.risk import round_trip_cost
from tidemark.session import stored


def signals(predictions: DataFrame, conviction_least: float = 0.3, move_least: float = 0.002, prob_least: float = 0.45, most: int | None = None) -> DataFrame:
    """predictions(.., conviction) that are strong enough, with action LONG or SHORT and strength; per time at most `most`,
    the strongest."""
    d = predictions.where((F.col("conviction") >= conviction_least) & (F.abs("magnitude") >= move_least))
    d = d.withColumn("action", F.when((F.col("direction") == "UP") & (F.col("prob_up") >= prob_least), "LONG").when((F.col("direction") == "DOWN") & (F.col("prob_down") >= prob_least), "SHORT"))
    d = d.where("action IS NOT NULL").withColumn("strength", F.col("conviction") * F.abs("magnitude"))
    if most is None:
        return d
    return d.withColumn("_r", F.row_number().over(Window.partitionBy("interval", "ts").orderBy(F.desc("strength"), "symbol"))).where(F.col("_r") <= most).drop("_r")


def exits(bars: DataFrame, entries: DataFrame, stop: float = 0.02, take: float = 0.03, hold: int = 24, reverse: bool = False) -> DataFrame:
    """entries(symbol, interval, ts, action) with entry_price, exit_ts, exit_price, exit_reason, bars_held and path, the
    (ts, close) of the bars between entry and exit.

    Each entry looks at the `hold` bars after it: the first one whose low or high passes the stop (first) or the target
    fills there, the last one closes at its close, and so does the last bar of the history. The bars after an entry are
    gathered by a bounded window frame, no join on ranges. With reverse, the first opposite entry after it closes the trade
    at that bar's close, unless the stop or the target came first or on that bar; a window that runs back in time finds it."""
    ahead = series().rowsBetween(1, hold)
    b = bars.select(*KEY, "ts", "close", F.collect_list(F.struct("ts", "high", "low", "close")).over(ahead).alias("next"))
    d = entries.select(*KEY, "ts", "action").join(b, [*KEY, "ts"])
    long = F.col("action") == "LONG"
    if reverse:
        later = Window.partitionBy(*KEY).orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, -1)
        nearest = lambda a: F.last(F.when(F.col("action") == a, F.struct("ts", "close")), ignorenulls=True).over(later)
        d = d.withColumn("_o", F.when(long, nearest("SHORT")).otherwise(nearest("LONG")))
    d = d.where(F.size("next") > 0)
    p = F.col("close")
    sl, tp = F.when(long, p * (1 - stop)).otherwise(p * (1 + stop)), F.when(long, p * (1 + take)).otherwise(p * (1 - take))
    d = d.withColumns({"_sl": sl, "_tp": tp, "entry_price": p})
    stopped = lambda x: F.when(F.col("action") == "LONG", x["low"] <= F.col("_sl")).otherwise(x["high"] >= F.col("_sl"))
    taken = lambda x: F.when(F.col("action") == "LONG", x["high"] >= F.col("_tp")).otherwise(x["low"] <= F.col("_tp"))
    looked = lambda x, i: F.struct(x["ts"].alias("ts"), stopped(x).alias("sl"), taken(x).alias("tp"), (i + 1).alias("n"))
    d = d.withColumn("_hit", F.get(F.filter(F.transform("next", looked), lambda x: x["sl"] | x["tp"]), F.lit(0)))
    h, last = F.col("_hit"), F.element_at("next", -1)
    reason = F.when(h["sl"], "stop_loss").when(h["tp"], "take_profit").when(F.size("next") == hold, "time").otherwise("end_of_backtest")
    d = d.withColumns({
        "exit_ts": F.coalesce(h["ts"], last["ts"]), "exit_price": F.when(h["sl"], F.col("_sl")).when(h["tp"], F.col("_tp")).otherwise(last["close"]),
        "exit_reason": reason, "bars_held": F.coalesce(h["n"], F.size("next")).cast("long"),
    })
    if reverse:
        o = F.col("_o")
        cut = o.isNotNull() & ((o["ts"] < F.col("exit_ts")) | ((o["ts"] == F.col("exit_ts")) & F.col("exit_reason").isin("time", "end_of_backtest")))
        d = d.withColumn("_cut", cut)
        d = d.withColumns({
            "exit_ts": F.when(F.col("_cut"), o["ts"]).otherwise(F.col("exit_ts")), "exit_price": F.when(F.col("_cut"), o["close"]).otherwise(F.col("exit_price")),
            "exit_reason": F.when(F.col("_cut"), "reversal").otherwise(F.col("exit_reason")),
        })
    between = F.filter("next", lambda x: x["ts"] < F.col("exit_ts"))
    held = F.size(between).cast("long") + 1 if reverse else F.col("bars_held")
    path = F.transform(between, lambda x: F.struct(x["ts"].alias("ts"), x["close"].alias("close")))
    return d.select(*KEY, "ts", "action", "entry_price", "exit_ts", "exit_price", "exit_reason", held.alias("bars_held"), path.alias("path"))


#: Trades of a run that are folded together; also how far one step of the chain over a long run goes.
BLOCK = 1024


def one_at_a_time(trades: DataFrame, key: list[str] | None = None) -> DataFrame:
    """The trades that a series can hold one after the other: the earliest, then the next that begins at its exit or later.
    Trades without a time are left out, one without an exit ends its series.

    Trades that overlap no other are kept at once, by a window. The others form runs; there each trade points to the one that
    would follow it, found by a sorted window over starts and exits, and the chain from a run's first trade is walked in
    blocks of at most BLOCK trades, folded as arrays. Of a run of several blocks, the first trade of the chain in each
    block comes from pointer jumping over those trades alone that a block can be entered by: as many rounds, of two joins, as
    the logarithm of the number of blocks."""
    key = key or list(KEY)
    kind = trades.schema["exit_ts"].dataType.simpleString()
    w = Window.partitionBy(*key).orderBy("ts", "_end")
    d = trades.where("ts IS NOT NULL").withColumn("_end", F.coalesce("exit_ts", F.lit("9999-12-31").cast(kind)))
    d = d.withColumns({"_n": F.row_number().over(w).cast("long"), "_over": F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    d = d.withColumn("_fresh", F.when(F.col("ts") < F.col("_over"), 0).otherwise(1)).drop("_over")
    d = d.withColumns({"_run": F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_alone": (F.col("_fresh") == 1) & (F.lead("_fresh", 1, 1).over(w) == 1)})
    d = stored(d)
    alone, runs = d.where("_alone"), d.where("NOT _alone")
    if not runs.isEmpty():
        of = F.to_json(F.struct(*key, "_run")).alias("_of")  # a name of its own for each run, series without a name included
        kept = _chain(runs.select(of, F.col("_n").alias("n"), F.col("ts").alias("start"), F.col("_end").alias("end")))
        alone = alone.unionByName(runs.withColumn("_of", of).join(kept.withColumnRenamed("n", "_n"), ["_of", "_n"], "left_semi").drop("_of"))
    return alone.select(trades.columns)


def _chain(runs: DataFrame) -> DataFrame:
    """(_of, n) of the trades kept, of runs(_of, n, start, end) numbered in order of their starts."""
    begins = runs.select("_of", F.col("start").alias("at"), F.lit(0).alias("ends"), "n")
    events = begins.union(runs.select("_of", F.col("end").alias("at"), F.lit(1).alias("ends"), "n"))
    # back in time, starts before exits at the same time: the first start at or after each exit
    back = Window.partitionBy("_of").orderBy(F.desc("at"), "ends").rowsBetween(Window.unboundedPreceding, 0)
    found = events.withColumn("to", F.min(F.when(F.col("ends") == 0, F.col("n"))).over(back)).where("ends = 1")
    to = F.when(F.col("to").isNotNull(), F.greatest("to", F.col("n") + 1)).alias("to")
    links = stored(found.select("_of", "n", to, F.floor(F.col("n") / BLOCK).alias("block")))
    firsts = links.groupBy("_of").agg(F.min("n").alias("n"), F.min("block").alias("low"), F.max("block").alias("high"))
    entries = firsts.select("_of", "n")
    longer = stored(firsts.where("low < high").select("_of", "n"))
    if not longer.isEmpty():
        entries = entries.union(_entries(links.join(longer.select("_of"), "_of", "left_semi"), longer)).distinct()
    entries = entries.select("_of", F.floor(F.col("n") / BLOCK).alias("block"), F.col("n").alias("entry"))
    rows = links.groupBy("_of", "block").agg(F.array_sort(F.collect_list(F.struct("n", "to"))).alias("x")).join(entries, ["_of", "block"])
    state = lambda next_, kept: F.struct(next_.alias("next"), kept.alias("kept")).cast("struct<next: bigint, kept: array<bigint>>")
    begin = state(F.col("entry"), F.array())
    walk = lambda a, t: F.when(t["n"] == a["next"], state(t["to"], F.array_append(a["kept"], t["n"]))).otherwise(a)
    return rows.select("_of", F.explode(F.aggregate("x", begin, walk, lambda a: a["kept"])).alias("n"))


def _entries(links: DataFrame, firsts: DataFrame) -> DataFrame:
    """(_of, n): the trades by which the chains that begin at firsts enter blocks."""

    def leave(rows: pd.DataFrame) -> pd.DataFrame:
        """For each trade of a block the first one outside that the chain through it comes to; at most BLOCK rows."""
        rows = rows.sort_values("n", ascending=False)
        out: dict[int, int | None] = {}
        for n, to in zip(rows["n"], rows["to"], strict=True):
            to = None if pd.isna(to) else int(to)
            out[n] = out.get(to, to)
        return rows.assign(to=pd.array([out[n] for n in rows["n"]], dtype="Int64"))[["_of", "n", "to"]]

    leaps = links.groupBy("_of", "block").applyInPandas(leave, "_of string, n bigint, to bigint").where("to IS NOT NULL")
    leaps, on = stored(leaps), firsts
    nodes = on.union(leaps.select("_of", F.col("to").alias("n"))).distinct()
    jump = stored(leaps.join(nodes, ["_of", "n"], "left_semi"))
    while not jump.isEmpty():
        on = stored(on.union(on.join(jump, ["_of", "n"]).select("_of", F.col("to").alias("n"))).distinct())
        further = jump.select("_of", F.col("n").alias("to"), F.col("to").alias("further"))
        jump = stored(jump.join(further, ["_of", "to"]).select("_of", "n", F.col("further").alias("to")))
    return on


def profit(trades: DataFrame, notional: float = 1000.0) -> DataFrame:
    """trades with gross_pnl, costs and net_pnl of a fixed notional."""
    move = F.try_divide(F.col("exit_price") - F.col("entry_price"), F.col("entry_price"))
    gross = F.lit(notional) * F.when(F.col("action") == "LONG", move).otherwise(-move)
    return trades.withColumns({"gross_pnl": gross, "costs": round_trip_cost(F.lit(notional))}).withColumn("net_pnl", F.col("gross_pnl") - F.col("costs"))


def with_path(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """trades that exits() didn't make, with path: the (ts, close) of the bars strictly between entry and exit.

    A trade meets its bars through their numbers, an equi-join; entry and exit must be times of bars."""
    n = bars.select(*KEY, "ts", "close", F.row_number().over(series()).alias("n"))
    t = trades.withColumn("_id", F.monotonically_increasing_id()).join(n.select(*KEY, "ts", F.col("n").alias("_from")), [*KEY, "ts"])
    t = t.join(n.select(*KEY, F.col("ts").alias("exit_ts"), F.col("n").alias("_to")), [*KEY, "exit_ts"])
    at = t.where("_to - _from > 1").select("_id", *KEY, F.explode(F.sequence(F.col("_from") + 1, F.col("_to") - 1)).alias("n"))
    path = at.join(n, [*KEY, "n"]).groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("ts", "close"))).alias("path"))
    return t.join(path, "_id", "left").withColumn("path", F.coalesce("path", F.array().cast(path.schema["path"].dataType))).drop("_id", "_from", "_to")


def equity_curve(trades: DataFrame, bars: DataFrame, capital: float = 10_000.0, notional: float = 1000.0) -> DataFrame:
    """(interval, ts, realized, unrealized, equity) at all times of bars: closed trades' net profit so far plus open ones
    marked at each close. A trade brings the closes that it is marked at, its path; one pass over trades and one over bars'
    times are added up by time, before the running sum and so before any sort. Equity is given to a millionth: else the order of
    sums would decide whether a capital that is used up is 0 or a little beside it, and with it the next return."""
    t = trades if "path" in trades.columns else with_path(trades, bars)
    move = lambda close: F.try_divide(close - F.col("entry_price"), F.col("entry_price")) * F.when(F.col("action") == "LONG", notional).otherwise(-notional)
    none = F.lit(0.0)
    marks = F.transform("path", lambda x: F.struct(x["ts"].alias("ts"), none.alias("net"), move(x["close"]).alias("mark")))
    ends = F.array(F.struct(F.col("exit_ts").alias("ts"), F.col("net_pnl").alias("net"), none.alias("mark")))
    happens = t.select("interval", F.explode(F.concat(marks, ends)).alias("e")).select("interval", "e.ts", "e.net", "e.mark")
    times = bars.select("interval", "ts", none.alias("net"), none.alias("mark"))
    d = times.union(happens).groupBy("interval", "ts").agg(F.sum("net").alias("net"), F.sum("mark").alias("unrealized"))
    w = Window.partitionBy("interval").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)  # a row a time
    d = d.select("interval", "ts", F.sum("net").over(w).alias("realized"), "unrealized")
    return d.withColumn("equity", F.round(capital + F.col("realized") + F.col("unrealized"), 6))


def performance(equity: DataFrame, by: list[str], periods_per_year: float = 365.25 * 24) -> DataFrame:
    """Per run: periods (points of the curve), total and annualised return, Sharpe, Sortino, worst drawdown, longest drawdown,
    Calmar. The annualised return takes the curve to span as many periods as it has points."""
    from tidemark.operators.risk import drawdown_series

    own = [f"_by{i}" for i in range(len(by))]  # the keys may have names that are used on the way
    w = Window.partitionBy(*own).orderBy("ts")
    before = F.lag("equity").over(w)
    d = drawdown_series(equity.select(*[F.col(c).alias(o) for c, o in zip(by, own, strict=True)], "ts", "equity"), own)
    d = d.withColumn("_r", F.try_divide(F.col("equity") - before, before))
    root, year = F.sqrt(F.lit(periods_per_year)), F.lit(periods_per_year)
    sd, down = F.stddev_samp("_r"), F.stddev_samp(F.when(F.col("_r") < 0, F.col("_r")))
    figure = lambda s: F.when(s > 1e-12, F.avg("_r") / F.nullif(s, F.lit(0.0)) * root).otherwise(0.0)
    g = d.groupBy(*own).agg(
        F.count("equity").alias("periods"), (F.max_by("equity", "ts") / F.min_by("equity", "ts") - 1).alias("total_return"),
        figure(sd).alias("sharpe"), figure(down).alias("sortino"), F.min("drawdown").alias("max_drawdown"), F.max("run").alias("longest_drawdown"),
    )
    grown = F.pow(1 + F.col("total_return"), F.try_divide(year, F.col("periods"))) - 1
    g = g.withColumn("annual_return", F.when((F.col("periods") > 1) & (F.col("total_return") > -1), grown))
    g = g.withColumn("calmar", F.try_divide(F.col("annual_return"), F.abs("max_drawdown")))
    return g.select(*[F.col(o).alias(c) for c, o in zip(by, own, strict=True)], *[c for c in g.columns if c not in own])


def trade_statistics(trades: DataFrame, by: list[str]) -> DataFrame:
    """trades(entry, exit, notional, net_pnl, costs): n, win rate, mean win and loss over notional, profit factor (NULL
    without losses), fees, mean hours held."""
    win, pnl = F.col("net_pnl") > 0, F.col("net_pnl")
    share = F.try_divide(pnl, F.col("notional"))
    lost = F.sum(F.when(~win, -pnl))
    return trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"), F.avg(win.cast("double")).alias("win_rate"), F.avg(F.when(win, share)).alias("avg_win"), F.avg(F.when(~win, share)).alias("avg_loss"),
        F.try_divide(F.coalesce(F.sum(F.when(win, pnl)), F.lit(0.0)), lost).alias("profit_factor"), F.sum("costs").alias("fees"), F.avg(F.timestamp_diff("SECOND", F.col("entry").cast("timestamp_ntz"), F.col("exit").cast("timestamp_ntz")) / 3600).alias("avg_hours"),
    )


def against_benchmark(returns: DataFrame, benchmark: DataFrame, by: list[str], periods_per_year: float = 365.25 * 24) -> DataFrame:
    """returns(.., ts, ret) against benchmark(ts, bench): its compounded return and the information ratio."""
    a = F.col("ret") - F.col("bench")
    sd = F.stddev_pop(a)
    return returns.join(benchmark, "ts").groupBy(*by).agg((F.product(1 + F.col("bench")) - 1).alias("benchmark_return"), F.when(sd > 1e-12, F.avg(a) / F.nullif(sd, F.lit(0.0)) * F.sqrt(F.lit(periods_per_year))).otherwise(0.0).alias("information_ratio"))


def folds(bars: DataFrame, k: int = 3, warmup: int = 0) -> DataFrame:
    """bars with the walk-forward fold that tests them: the usable times are cut in k + 1, the first trains only."""
    w = Window.partitionBy(*KEY)
    d = bars.withColumns({"_n": F.row_number().over(series()), "_all": F.count(F.lit(1)).over(w)})
    size = F.floor((F.col("_all") - warmup) / (k + 1))
    fold = F.floor((F.col("_n") - 1 - warmup) / F.greatest(size, F.lit(1)))
    return d.withColumn("fold", fold).where((F.col("fold") >= 1) & (F.col("fold") <= k)).drop("_n", "_all")


def blocked(performance_rows: DataFrame, least: float = -1.0) -> DataFrame:
    """The runs whose Sharpe ratio forbids deployment."""
    return performance_rows.where(F.col("sharpe") < least)
