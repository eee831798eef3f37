"""Column helpers: windows over a series, safe ratios, scores of class probabilities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

#: A series is the rows of one key in time order.
KEY = ("symbol", "interval")


def series(*key: str) -> WindowSpec:
    return Window.partitionBy(*(key or KEY)).orderBy("ts")


def last_rows(n: int, *key: str) -> WindowSpec:
    return series(*key).rowsBetween(-(n - 1), 0)


def so_far(*key: str) -> WindowSpec:
    return series(*key).rowsBetween(Window.unboundedPreceding, 0)


def seconds(span: str) -> float:
    """Of a span like "7 days"."""
    n, unit = span.split()
    return float(n) * {"minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rolling(agg: Callable[[Column], Column], x: Column | str, n: int, least: int | None = None, key: tuple = KEY) -> Column:
    """agg of the last n rows; NULL until `least` of them (all n by default) have a value."""
    w = last_rows(n, *key)
    return F.when(F.count(col(x)).over(w) >= (n if least is None else least), agg(col(x)).over(w))


def ratio(a, b) -> Column:
    """a / b, NULL where b is 0 or either is NULL."""
    return F.try_divide(a, b)


def float_ratio(a, b) -> Column:
    """a / b as floats divide: by 0 inf, -inf or NaN, after a's sign; NULL where either is NULL."""
    a, b = col(a).cast("double"), col(b).cast("double")
    by_zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a.isNotNull(), float("nan"))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def lagged(x: Column | str, k: int = 1, key: tuple = KEY) -> Column:
    return F.lag(col(x), k).over(series(*key))


def pct(x: Column | str, k: int = 1, key: tuple = KEY) -> Column:
    before = lagged(x, k, key)
    return ratio(col(x) - before, before)


def zscore(x: Column | str, n: int, least: int | None = None, key: tuple = KEY) -> Column:
    """(x - mean) / sample deviation over the last n rows; NULL for a constant window."""
    sd = rolling(F.stddev_samp, x, n, least, key)
    return F.when(sd > 1e-12, (col(x) - rolling(F.avg, x, n, least, key)) / sd)


def direction(change: Column | str, threshold: float | Column = 0.005) -> Column:
    """UP above the threshold, DOWN below its negative, else FLAT (equality is FLAT); NULL for NULL."""
    x = col(change)
    return F.when(x > threshold, "UP").when(x < -threshold, "DOWN").when(x.isNotNull(), "FLAT")


def argmax3(up, flat, down) -> Column:
    """The likeliest class of three; the first wins a tie."""
    up, flat, down = map(col, (up, flat, down))
    return F.when((up >= flat) & (up >= down), "UP").when(flat >= down, "FLAT").otherwise("DOWN")


def conviction(up, flat, down) -> Column:
    """1 less the entropy of the probabilities over ln 3, at least 0."""
    h = sum((F.when(p > 0, -p * F.log(p)).otherwise(0.0) for p in map(col, (up, flat, down))), F.lit(0.0))
    return F.greatest(F.lit(0.0), 1 - h / F.log(F.lit(3.0)))


def signal_score(up, flat, down, magnitude, uncertainty=None) -> Column:
    score = conviction(up, flat, down) * F.greatest(col(up), col(down)) * F.abs(col(magnitude)) * 100
    return score if uncertainty is None else score * F.greatest(F.lit(0.1), 1 - col(uncertainty))


def log_odds_blend(a: list, b: list, wa: float | Column, wb: float | Column) -> list[Column]:
    """Per class: weighted sum of log odds, back to probabilities, renormalised."""

    def logit(p):
        p = F.least(F.greatest(col(p), F.lit(1e-8)), F.lit(1 - 1e-8))
        return F.log(p / (1 - p))

    odds = [1 / (1 + F.exp(-(wa * logit(x) + wb * logit(y)))) for x, y in zip(a, b, strict=True)]
    total = odds[0] + odds[1] + odds[2]
    return [o / total for o in odds]


def number_list_sum(text: Column | str) -> Column:
    """A number, or the sum of a JSON list's numbers; 0 for anything else."""
    t = col(text)
    values = F.from_json(t, "array<double>")
    return F.coalesce(t.try_cast("double"), F.aggregate(F.filter(values, lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + x), F.lit(0.0))
