"""Alignment of series: exact, as-of, outcome, leader, full outer with fill, pairs."""

from __future__ import annotations

from dataclasses import dataclass, field

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import KEY, seconds, series, so_far


def tradeable(futures: DataFrame, spot: DataFrame) -> DataFrame:
    """Futures symbols whose lower-cased name is an open spot pair, in order."""
    open_ = spot.where("is_open = 1").select(F.lower("pair").alias("_p"))
    return futures.select("symbol").distinct().join(open_, F.lower("symbol") == F.col("_p"), "left_semi").orderBy("symbol")


def futures_only(futures: DataFrame, spot: DataFrame) -> DataFrame:
    open_ = spot.where("is_open = 1").select(F.lower("pair").alias("_p"))
    return futures.select("symbol").distinct().join(open_, F.lower("symbol") == F.col("_p"), "left_anti")


def symbol_map(markets: DataFrame, ours: DataFrame) -> DataFrame:
    """(symbol, market) of markets(market, base, quote, exchange, is_perpetual, pos): base and quote against our name in
    capitals without dashes; of several markets the later one wins."""
    m = markets.where("is_perpetual").withColumn("_k", F.upper(F.concat("base", "quote")))
    last = m.groupBy("_k").agg(F.max_by("market", "pos").alias("market"))
    return ours.select("symbol", F.regexp_replace(F.upper("symbol"), "-", "").alias("_k")).join(last, "_k").select("symbol", "market")


def exact(bars: DataFrame, side: DataFrame, features: list[str], on: list[str] | None = None, fill: float = 0.0) -> DataFrame:
    """bars with the side series' features at the same symbol and time; where it has none, the fill."""
    out = bars.join(side.select(*(on or ["symbol", "ts"]), *features), on or ["symbol", "ts"], "left")
    return out.withColumns({f: F.coalesce(f, F.lit(fill)) for f in features})


@dataclass
class Side:
    """A side series(key, ts, features): used while no older than the age (0: at its very time only), else its fills."""

    rows: DataFrame
    features: list[str]
    max_age_minutes: float | None = None
    fills: dict[str, float] = field(default_factory=dict)


def as_of_all(bars: DataFrame, sides: list[Side], key: str = "symbol", bucket: str = "1 day") -> DataFrame:
    """bars with the features of each side's latest row at or before each; NULL, or the fill, without one or if it is older
    than the limit. Of side rows at the same time the last by its features counts. A bar without a time has none; bars
    without a symbol meet side rows without one.

    All sides are stacked on the bars once, and their last snapshots are carried forward together within buckets of time, so
    that a symbol's history is not one task's and the bars are shuffled once, however many sides there are. What a bucket
    begins with is carried over one row a symbol and bucket. No range join."""
    snaps = [f"_snap{i}" for i in range(len(sides))]
    own = [F.struct(F.col("ts").alias("at"), *s.features) for s in sides]
    kinds = [s.rows.select(o.alias("s")).schema["s"].dataType for s, o in zip(sides, own, strict=True)]
    both = bars.withColumns({"_side": F.lit(1)} | {n: F.lit(None).cast(k) for n, k in zip(snaps, kinds, strict=True)})
    for n, s, o in zip(snaps, sides, own, strict=True):
        both = both.unionByName(s.rows.select(key, "ts", F.lit(0).alias("_side"), o.alias(n)), allowMissingColumns=True)
    at = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    both = both.withColumn("_b", F.floor(at / seconds(bucket)))
    earlier = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    carry = both.groupBy(key, "_b").agg(*[F.max(n).alias(f"{n}_c") for n in snaps])
    carry = carry.withColumns({f"{n}_c": F.last(f"{n}_c", ignorenulls=True).over(earlier) for n in snaps})
    w = Window.partitionBy(key, "_b").orderBy("ts", "_side", *snaps).rowsBetween(Window.unboundedPreceding, 0)
    carry = carry.select(F.struct(key, "_b").alias("_of"), *[f"{n}_c" for n in snaps])  # structs compare NULLs as equal
    out = both.withColumns({n: F.last(n, ignorenulls=True).over(w) for n in snaps}).where("_side = 1").withColumn("_of", F.struct(key, "_b")).join(carry, "_of")
    out = out.withColumns({n: F.coalesce(n, f"{n}_c") for n in snaps})
    got = {}
    for n, s in zip(snaps, sides, strict=True):
        fresh = F.col("ts").isNotNull() if s.max_age_minutes is None else F.timestamp_diff("SECOND", F.col(f"{n}.at"), F.col("ts")) <= 60 * s.max_age_minutes
        for f in s.features:
            x = F.when(fresh, F.col(f"{n}.{f}"))
            got[f] = F.coalesce(x, F.lit(s.fills[f])) if f in s.fills else x
    return out.withColumns(got).drop("_side", "_b", "_of", *snaps, *[f"{n}_c" for n in snaps])


def as_of(bars: DataFrame, side: DataFrame, features: list[str], key: str = "symbol", max_age_minutes: float | None = None, fills: dict[str, float] | None = None, bucket: str = "1 day") -> DataFrame:
    """as_of_all() of one side."""
    return as_of_all(bars, [Side(side, features, max_age_minutes, fills or {})], key, bucket)


def outcomes(predictions: DataFrame, bars: DataFrame, threshold: float = 0.005) -> DataFrame:
    """predictions with actual_magnitude, actual_direction, was_correct, scored_at from the candle at their time and the
    first one after it; NULLs, so still unscored, where either is missing or the base close is 0."""
    from tidemark.functions.columns import direction

    nxt = bars.select(*KEY, "ts", F.col("close").alias("_base"), F.lead("close").over(series()).alias("_next"), F.lead("ts").over(series()).alias("scored_at"))
    out = predictions.join(nxt, [*KEY, "ts"], "left")
    out = out.withColumn("actual_magnitude", F.when(F.col("_base") != 0, (F.col("_next") - F.col("_base")) / F.nullif("_base", F.lit(0.0))))
    out = out.withColumn("actual_direction", direction("actual_magnitude", threshold))
    return out.withColumns({"was_correct": F.col("actual_direction") == F.col("direction"), "scored_at": F.when(F.col("actual_magnitude").isNotNull(), F.col("scored_at"))}).drop("_base", "_next")


def with_leader(bars: DataFrame, leader: str, columns: list[str]) -> DataFrame:
    """bars with the leader's columns at the same time as leader_<column>; its rows are one series, small beside bars."""
    side = bars.where(F.col("symbol") == leader).select("interval", "ts", *[F.col(c).alias(f"leader_{c}") for c in columns])
    return bars.join(side, ["interval", "ts"], "left")


def filled_outer(a: DataFrame, b: DataFrame, value: str, key: str = "symbol") -> DataFrame:
    """(key, ts, a_value, b_value) at the times of either, each carried forward."""
    both = a.select(key, "ts", F.col(value).alias("a")).join(b.select(key, "ts", F.col(value).alias("b")), [key, "ts"], "full")
    w = so_far(key)
    return both.select(key, "ts", F.last("a", ignorenulls=True).over(w).alias("a_value"), F.last("b", ignorenulls=True).over(w).alias("b_value"))


def pair_correlations(
    returns: DataFrame, value: str = "ret", unit: str = "symbol", least: int = 24, high: float = 0.70, points: int = 10, tail: str = "shared", within: tuple = (), block: int = 4096, together: int = 256
) -> DataFrame:
    """(a, b, points, r, is_correlated) for a <= b: units with enough values, aligned by rank from the end, over the shortest
    of all tails ("shared") or each pair's own shorter one ("pair"). Units are paired within the columns of `within` only,
    which come first in the output then. The output is one row a pair.

    A unit's values go in arrays of `block` ranks. Units are dealt to groups of about `together`, as many as there are units
    for, and two groups' arrays of a block meet once, in a task that holds their two matrices and gives the sums of all its
    pairs as matrix products: memory stays the same however many units there are."""
    back = F.row_number().over(Window.partitionBy(*within, unit).orderBy(F.desc("ts")))
    whole = Window.partitionBy(*within, unit)
    units = returns.groupBy(*within).agg(F.approx_count_distinct(unit).alias("n")).agg(F.max("n")).first()[0] or 0
    groups = max(1, math.ceil(units / together))
    r = returns.where(F.col(value).isNotNull()).select(*within, unit, F.col(value).cast("double").alias("v"), back.alias("back"), F.count(F.lit(1)).over(whole).alias("n"), F.avg(value).over(whole).alias("mean"))
    r = r.where(F.col("n") >= least)
    if tail == "shared":
        shortest = r.groupBy(*within).agg(F.min("n").alias("m"))
        r = (r.join(shortest, list(within)) if within else r.crossJoin(F.broadcast(shortest))).where("back <= m")  # one row
    # less the unit's mean, which changes no correlation but keeps the sums small
    x = r.groupBy(*within, unit, F.floor((F.col("back") - 1) / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("back", (F.col("v") - F.col("mean")).alias("v")))).alias("x"))
    x = x.select(*within, F.col(unit).alias("u"), "block", F.transform("x", lambda e: e["v"]).alias("x"), F.pmod(F.xxhash64(unit), F.lit(groups)).alias("g"))
    upto = lambda a, b: F.explode(F.sequence(a, b).cast("array<bigint>"))
    left = x.select(*within, "block", "u", "x", F.lit(0).alias("side"), F.col("g").alias("ga"), upto(F.col("g"), F.lit(groups - 1)).alias("gb"))
    right = x.select(*within, "block", "u", "x", F.lit(1).alias("side"), upto(F.lit(0), F.col("g")).alias("ga"), F.col("g").alias("gb")).where("ga < gb")
    names = ["points", "sx", "sy", "sxx", "syy", "sxy"]
    kinds = [f"{c} {returns.schema[c].dataType.simpleString()}" for c in within] + [f"{c} {returns.schema[unit].dataType.simpleString()}" for c in "ab"]

    def met(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Sums over the ranks that both units of a pair have, for all pairs of two groups in a block."""
        a = rows[rows["side"] == 0]
        b = a if key[len(within)] == key[len(within) + 1] else rows[rows["side"] == 1]
        (va, ha), (vb, hb) = (_padded(s["x"], block) for s in (a, b))
        sums = [ha @ hb.T, va @ hb.T, ha @ vb.T, (va * va) @ hb.T, ha @ (vb * vb).T, va @ vb.T]
        i, j = np.nonzero(a["u"].to_numpy()[:, None] <= b["u"].to_numpy()[None, :]) if a is b else map(np.ravel, np.indices((len(a), len(b))))
        first, second = a["u"].to_numpy(object)[i], b["u"].to_numpy(object)[j]
        found = dict(zip(names, (x[i, j] for x in sums), strict=True))
        turned = first > second
        for p, q in (("sx", "sy"), ("sxx", "syy")):
            found[p], found[q] = np.where(turned, found[q], found[p]), np.where(turned, found[p], found[q])
        named = {c: [k] * len(i) for c, k in zip(within, key, strict=False)} | {"a": np.where(turned, second, first), "b": np.where(turned, first, second)}
        return pd.DataFrame({c: pd.Series(x, dtype=object) for c, x in named.items()} | found)

    met_rows = left.unionByName(right).groupBy(*within, "ga", "gb", "block").applyInPandas(met, ", ".join([*kinds, *[f"{n} double" for n in names]]))
    out = met_rows.groupBy(*within, "a", "b").agg(*[F.sum(n).alias(n) for n in names]).withColumn("points", F.round("points").cast("long")).where("points > 0")
    n, sx, sy = F.col("points"), F.col("sx"), F.col("sy")
    spread = F.sqrt((n * F.col("sxx") - sx * sx) * (n * F.col("syy") - sy * sy))
    out = out.select(*within, "a", "b", "points", F.when(spread > 0, (n * F.col("sxy") - sx * sy) / spread).alias("r"))
    return out.withColumn("is_correlated", (F.abs("r") >= high) & (F.col("points") >= points))


def _padded(arrays: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Arrays as rows of a matrix with zeros behind them, and where they have values."""
    values, has = np.zeros((len(arrays), width)), np.zeros((len(arrays), width))
    for i, x in enumerate(arrays):
        values[i, : len(x)], has[i, : len(x)] = x, 1
    return values, has


def latest(bars: DataFrame, n: int, before: Column | None = None) -> DataFrame:
    """The newest n rows of each series (before a time), for all series at once."""
    d = bars if before is None else bars.where(F.col("ts") < before)
    return d.withColumn("_r", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("ts")))).where(F.col("_r") <= n).drop("_r")
