"""Position sizes, exits, costs, limits, and the drawdown state machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kelly(capital, win_rate, avg_win, avg_loss, conviction, half: float = 0.5, low: float = 0.01, high: float = 0.10) -> Column:
    """Half Kelly within limits, times conviction; 1 % where the edge isn't there."""
    b = F.try_divide(avg_win, avg_loss)
    f = F.try_divide(win_rate * b - (1 - win_rate), b) * half
    return capital * F.when((avg_loss > 0) & (win_rate > 0) & (f > 0), F.least(F.lit(high), F.greatest(F.lit(low), f)) * conviction).otherwise(low)


def by_volatility(capital, atr_pct, risk: float = 0.01, default: float = 0.02, high: float = 0.10) -> Column:
    return capital * F.when(atr_pct > 0, F.least(F.lit(high), F.try_divide(F.lit(risk), 2 * atr_pct))).otherwise(default)


def fixed(capital, share: float = 0.05) -> Column:
    return capital * share


def stop_prices(price, atr, side, stop: float = 2.0, take: float = 3.0) -> tuple[Column, Column]:
    sign = F.when(side == "LONG", 1).otherwise(-1)
    return price - sign * stop * atr, price + sign * take * atr


def round_trip_cost(notional, hours=None, fee: float = 0.0006, slippage: float = 0.0005, funding: float = 0.0) -> Column:
    """Fee and slippage on both sides, and funding for every eight hours held."""
    cost = 2 * notional * (fee + slippage)
    return cost if hours is None else cost + notional * funding * hours / 8


def position_limits(candidates: DataFrame, positions: DataFrame, correlated: DataFrame, capital: float, single: float = 0.10, total: float = 0.50, most_correlated: int = 3) -> DataFrame:
    """candidates(symbol, notional) with open_notional, n_correlated, may_open and the reason against: single size, then
    total exposure, then correlated positions."""
    open_ = positions.agg(F.coalesce(F.sum("notional"), F.lit(0.0)).alias("open_notional"))
    pairs = correlated.where("is_correlated AND a <> b")
    both = pairs.select(F.col("a").alias("symbol"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    n = both.join(positions.select(F.col("symbol").alias("other")).distinct(), "other").groupBy("symbol").agg(F.count(F.lit(1)).alias("n_correlated"))
    d = candidates.crossJoin(F.broadcast(open_)).join(n, "symbol", "left").withColumn("n_correlated", F.coalesce("n_correlated", F.lit(0).cast("long")))  # one row
    reason = F.when(F.col("notional") > single * capital, "single").when(F.col("open_notional") + F.col("notional") > total * capital, "total").when(F.col("n_correlated") >= most_correlated, "correlated")
    return d.withColumn("reason", reason).withColumn("may_open", reason.isNull())


class Drawdown:
    """Trading state by drawdown from the highest equity so far: NORMAL, REDUCED from one drawdown on, HALTED from a deeper
    one. HALTED ends in RECOVERING, when equity has risen by a share of the halting drawdown since it halted; RECOVERING ends
    in NORMAL under the first drawdown and in HALTED again at the deeper one. multiplier is the size that is allowed: in
    RECOVERING it grows from the reduced one to the whole over so many periods. Nothing happens before equity is positive."""

    def __init__(self, reduce: float = 0.05, halt: float = 0.10, recovery: float = 0.5, ramp: int = 24, reduced: float = 0.5):
        self.reduce, self.halt, self.back, self.ramp, self.reduced = reduce, halt, recovery * halt, ramp, reduced
        self.state, self.peak, self.halted_at, self.periods = "NORMAL", 0.0, 0.0, 0

    def after(self, drawdown: float, equity: float) -> str:
        """The state that follows the present one."""
        if self.state == "HALTED":
            return "RECOVERING" if self.halted_at > 0 and equity / self.halted_at - 1 >= self.back else "HALTED"
        if drawdown >= self.halt:
            return "HALTED"
        if drawdown < self.reduce:
            return "NORMAL"
        return "RECOVERING" if self.state == "RECOVERING" else "REDUCED"

    def update(self, equity: float) -> tuple[str, float, float]:
        self.peak = max(self.peak, equity)
        drawdown = 0.0
        if self.peak > 0:
            drawdown = (self.peak - equity) / self.peak
            state = self.after(drawdown, equity)
            if state == "HALTED" != self.state:
                self.halted_at = equity
            self.periods = self.periods + 1 if state == self.state else 0
            self.state = state
        grown = self.reduced + (1 - self.reduced) * min(1.0, self.periods / max(1, self.ramp))
        return self.state, drawdown, {"NORMAL": 1.0, "REDUCED": self.reduced, "HALTED": 0.0, "RECOVERING": grown}[self.state]


def drawdown_states(equity: DataFrame, key: str = "portfolio", **limits) -> DataFrame:
    """(key, ts, equity, state, drawdown, multiplier): the machine over each portfolio's curve.

    Each row's state needs the one before it, so a curve stays in one task; but the task streams its sorted rows batch by
    batch and holds the machine's four values, never a curve. Equal times go by equity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, own = Drawdown(**limits), object()
        for rows in batches:
            got = []
            for of, value in zip(rows[key], rows["equity"], strict=True):
                if of != own and not (pd.isna(of) and own is None):
                    machine, own = Drawdown(**limits), None if pd.isna(of) else of
                got.append(machine.update(value))
            yield rows.assign(state=[g[0] for g in got], drawdown=[g[1] for g in got], multiplier=[g[2] for g in got])[[key, "ts", "equity", "state", "drawdown", "multiplier"]]

    kinds = {c: equity.schema[c].dataType.simpleString() for c in (key, "ts")}
    rows = equity.select(key, "ts", F.col("equity").cast("double").alias("equity")).repartition(key).sortWithinPartitions(key, "ts", "equity")
    return rows.mapInPandas(run, f"{key} {kinds[key]}, ts {kinds['ts']}, equity double, state string, drawdown double, multiplier double")


def drawdown_series(equity: DataFrame, key: list[str]) -> DataFrame:
    """equity with peak, drawdown (0 or below) and run: how many periods the drawdown has lasted."""
    w = Window.partitionBy(*key).orderBy("ts")
    d = equity.withColumn("peak", F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("drawdown", F.try_divide(F.col("equity") - F.col("peak"), F.col("peak")))
    d = d.withColumn("_g", F.sum(F.when(F.col("drawdown") < 0, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn("run", F.sum(F.when(F.col("drawdown") < 0, 1).otherwise(0)).over(Window.partitionBy(*key, "_g").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))).drop("_g")
