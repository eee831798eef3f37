"""Recursive smoothing on Spark: y[n] = (1 - a) y[n-1] + a x[n], by windows alone.

One step is affine, so the rows of a series can be cut into blocks: within a block the sum of x over powers of (1 - a) is an
ordinary running sum, and a block only needs what the one before it ended with. That end needs the one before it, and so on,
but each counts (1 - a) to the power of a block's rows less: a block is long enough that very few of them still show in a
double. So no block waits for all before it, a series is read once and sorted by the same key as for every other window."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import KEY, last_rows, series, so_far

#: Powers of 1 - a in a block stay within exp of this; what counts less than exp of that doesn't show in a double.
LARGEST, LEAST = 550.0, 40.0


@dataclass(frozen=True)
class Smooth:
    """out: the smoothed column x with weight alpha, NULL before `least` values. The first value seeds the average."""

    x: str
    out: str
    alpha: float
    least: int = 1


def ema(x: str, out: str, n: int) -> Smooth:
    return Smooth(x, out, 2 / (n + 1), n)


def memory(alpha: float) -> int:
    """Rows after which a value no longer shows in an average of this weight: the halo that a piece of a series needs."""
    return math.ceil(-LEAST / math.log1p(-alpha))


def smooth(df: DataFrame, specs: list[Smooth], key: tuple = KEY, rows: int | None = None) -> DataFrame:
    """df with a column for each of specs; weights are under 1. NULLs of x may only lead a series. Blocks have `rows` rows, or
    as many as the largest weight allows."""
    rates = [-math.log1p(-s.alpha) for s in specs]
    rows = rows or int(LARGEST / max(rates))
    earlier = math.ceil(LEAST / (rows * min(rates)))  # blocks before the last one that still show
    many = range(len(specs))
    d = df.withColumns({"_sm_n": F.row_number().over(series(*key)) - 1} | {f"_sm_k{i}": F.count(s.x).over(so_far(*key)) for i, s in enumerate(specs)})
    d = d.withColumns({"_sm_b": F.floor(F.col("_sm_n") / rows), "_sm_j": (F.col("_sm_n") % rows).cast("double")})
    inside = Window.partitionBy(*key, "_sm_b").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    # the first value counts whole, not by its weight
    part = lambda i, s: F.sum(F.col(s.x) * F.when(F.col(f"_sm_k{i}") == 1, 1 / s.alpha).otherwise(1.0) * F.exp(rates[i] * F.col("_sm_j"))).over(inside)
    d = d.withColumns({f"_sm_l{i}": F.coalesce(s.alpha * part(i, s) * F.exp(-rates[i] * F.col("_sm_j")), F.lit(0.0)) for i, s in enumerate(specs)})
    d = d.withColumns({f"_sm_y{i}": F.col(f"_sm_l{i}") for i in many})
    before = series(*key).rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(earlier):
        end = lambda i: F.last(F.when(F.col("_sm_j") == rows - 1, F.col(f"_sm_y{i}")), ignorenulls=True).over(before)
        d = d.withColumns({f"_sm_e{i}": F.coalesce(end(i), F.lit(0.0)) for i in many})
        d = d.withColumns({f"_sm_y{i}": F.col(f"_sm_l{i}") + F.exp(-rates[i] * (F.col("_sm_j") + 1)) * F.col(f"_sm_e{i}") for i in many})
    d = d.withColumns({s.out: F.when(F.col(f"_sm_k{i}") >= s.least, F.col(f"_sm_y{i}")) for i, s in enumerate(specs)})
    return d.drop("_sm_n", "_sm_b", "_sm_j", *[f"{c}{i}" for i in many for c in ("_sm_k", "_sm_l", "_sm_y", "_sm_e")])


def wilder_seeded(df: DataFrame, columns: dict[str, str], n: int = 14, key: tuple = KEY) -> DataFrame:
    """df with a column `out` for each {x: out}: x where a Wilder average of n starts with the plain mean of the first n
    values and goes on by 1/n; smooth it with alpha 1/n. NULL before."""
    have = {x: F.count(x).over(so_far(*key)) for x in columns}
    mean = {x: F.avg(x).over(last_rows(n, *key)) for x in columns}
    return df.withColumns({out: F.when(F.col(x).isNull(), None).when(have[x] == n, mean[x]).when(have[x] > n, F.col(x)) for x, out in columns.items()})
