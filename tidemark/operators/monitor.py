"""Drift, calibration, A/B evaluation, model gates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLASSES = ("UP", "FLAT", "DOWN")


def newest(rows: DataFrame, n: int, by: list[str]) -> DataFrame:
    """The newest n rows of each group; a group of n rows at most is ranked by one task, the rest is cut by its rank."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("ts"), "symbol"))).where(F.col("_r") <= n).drop("_r")


def kl_drift(recent: DataFrame, baseline: DataFrame, by: list[str], least: int = 30, limit: float = 0.1) -> DataFrame:
    """Per group: n, kl of the recent class shares against the baseline's, is_drift. Too few rows give NULL."""

    def shares(d: DataFrame, name: str) -> DataFrame:
        n = F.count(F.lit(1))
        return d.groupBy(*by).agg(n.alias(f"{name}_n"), *[F.greatest(F.count_if(F.col("direction") == c) / n, F.lit(1e-10)).alias(f"{name}_{c}") for c in CLASSES])

    d = shares(recent, "p").join(shares(baseline, "q"), by)
    total = lambda n: sum((F.col(f"{n}_{c}") for c in CLASSES), F.lit(0.0))
    kl = sum((F.col(f"p_{c}") / total("p") * F.log(F.col(f"p_{c}") / total("p") / (F.col(f"q_{c}") / total("q"))) for c in CLASSES), F.lit(0.0))
    enough = (F.col("p_n") >= least) & (F.col("q_n") >= least)
    return d.select(*by, F.col("p_n").alias("n"), F.when(enough, kl).alias("kl"), F.when(enough, kl > limit).alias("is_drift"))


def calibration(scored: DataFrame, bins: int = 10, limit: float = 0.15, clamp_last: bool = False) -> DataFrame:
    """One row: n, ece, is_degraded, over the rows that are in a bin. Bins of the largest probability, closed below; 1.0 is in
    none unless clamp_last. No rows give an error of 0."""
    p = F.greatest("prob_up", "prob_flat", "prob_down")
    b = F.floor(p * bins)
    b = F.least(b, F.lit(bins - 1)) if clamp_last else b
    d = scored.select(p.alias("p"), b.alias("b"), F.col("was_correct").cast("double").alias("ok"))
    n = d.where(F.col("b") < bins).groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("conf"), F.avg("ok").alias("acc"))
    g = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))), F.lit(0.0)).alias("e"))
    ece = F.col("e") / F.greatest("n", F.lit(1))
    return g.select("n", ece.alias("ece"), (ece > limit).alias("is_degraded"))


def sharpe(x: Column, periods: float = 8760) -> Column:
    sd = F.stddev_samp(x)
    return F.when((F.count(x) < 2) | sd.isNull() | (sd < 1e-10), 0.0).otherwise(F.try_divide(F.avg(x), sd) * F.sqrt(F.lit(periods)))


def ab_test(results: DataFrame, least: int = 100, days: float = 7, edge: float = 0.1) -> DataFrame:
    """One row of results(arm, ts, pnl): n, days, both Sharpe ratios, promote and why."""
    arm = lambda a: F.when(F.col("arm") == a, F.col("pnl"))
    d = results.agg(
        F.count_if(F.col("arm") == "shadow").alias("n"), (F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")) / 86400).alias("days"),
        sharpe(arm("production")).alias("production_sharpe"), sharpe(arm("shadow")).alias("shadow_sharpe"),
    )
    why = F.when(F.col("n") < least, "samples").when(F.col("days") < days, "days").when(F.col("shadow_sharpe") - F.col("production_sharpe") < edge, "edge").otherwise("promote")
    return d.withColumn("reason", why).withColumn("promote", why == "promote")


def model_eval(scored: DataFrame, by: list[str], weights: dict[str, float] | None = None, delta: float = 1.0) -> DataFrame:
    """Per model: accuracy, mae, loss (weighted cross-entropy of the actual class plus Huber of the magnitude)."""
    p = F.when(F.col("actual_direction") == "UP", F.col("prob_up")).when(F.col("actual_direction") == "FLAT", F.col("prob_flat")).otherwise(F.col("prob_down"))
    w = F.lit(1.0)
    for c, x in (weights or {}).items():
        w = F.when(F.col("actual_direction") == c, x).otherwise(w)
    err = F.abs(F.col("magnitude") - F.col("actual_magnitude"))
    huber = F.when(err <= delta, 0.5 * err * err).otherwise(delta * (err - 0.5 * delta))
    ce = -w * F.log(F.greatest(p, F.lit(1e-12)))
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("direction") == F.col("actual_direction")).cast("double")).alias("accuracy"), F.avg(err).alias("mae"), (F.sum(ce) / F.sum(w) + F.avg(huber)).alias("loss"))


def deploy_gate(evals: DataFrame, new: str, old: str, worse: float = 1.05) -> DataFrame:
    """One row: both losses and whether the new model goes out."""
    loss = lambda m: F.max(F.when(F.col("model") == m, F.col("loss")))
    d = evals.agg(loss(new).alias("new_loss"), loss(old).alias("old_loss"))
    return d.withColumn("deploy", F.coalesce(F.col("new_loss") <= worse * F.col("old_loss"), F.lit(True)))


def temperature(scored: DataFrame, candidates: list[float]) -> DataFrame:
    """One row: temperature with the least mean negative log likelihood of softmax(log p / T) and that NLL; ties to the
    first; never worse than T = 1. All candidates go in one pass."""
    g = _likelihoods(scored, sorted({1.0, *map(float, candidates)}))
    return g.orderBy(F.round("nll", 9), "t").limit(1).select(F.col("t").alias("temperature"), "nll")


def _likelihoods(scored: DataFrame, candidates: list[float]) -> DataFrame:
    """(t, nll) of each candidate, in one pass: rows are multiplied in a narrow stage and added up before the shuffle."""
    ps = ("prob_up", "prob_flat", "prob_down")
    d = scored.select(*ps, "actual_direction", F.explode(F.array(*map(F.lit, candidates))).alias("t"))
    e = {p: F.pow(F.greatest(F.col(p), F.lit(1e-12)), 1 / F.col("t")) for p in ps}
    own = F.when(F.col("actual_direction") == "UP", e["prob_up"]).when(F.col("actual_direction") == "FLAT", e["prob_flat"]).otherwise(e["prob_down"])
    return d.groupBy("t").agg(F.avg(-F.log(own / (e["prob_up"] + e["prob_flat"] + e["prob_down"]))).alias("nll"))


#: No temperature is smaller, nor larger.
COLDEST, HOTTEST = 0.01, 100.0


def fitted_temperature(scored: DataFrame, tolerance: float = 1e-4, inside: int = 6) -> tuple[float, float]:
    """(temperature, nll): the temperature from COLDEST to HOTTEST with the least mean negative log likelihood, to a relative
    tolerance, and 1 unless it is better. Sections of one pass each: the likelihood is convex in 1/T, so it falls and then
    rises, and of `inside` candidates the two next to the best one bound what the next pass looks at. (1, nan) without rows."""
    low, high = math.log(COLDEST), math.log(HOTTEST)
    best, least, whole = 1.0, math.inf, math.nan
    while high - low > tolerance:
        marks = [low + (high - low) * i / (inside + 1) for i in range(inside + 2)]
        tried = {math.exp(m): m for m in marks} | {1.0: 0.0}
        got = {r.t: r.nll for r in _likelihoods(scored, sorted(tried)).collect() if r.nll is not None}  # a row a candidate
        if not got:
            return 1.0, math.nan
        whole = got[1.0]
        values = [got[math.exp(m)] for m in marks]
        at = values.index(min(values))
        if values[at] < least:
            best, least = math.exp(marks[at]), values[at]
        low, high = marks[max(0, at - 1)], marks[min(len(marks) - 1, at + 1)]
    return (best, least) if least < whole else (1.0, whole)
