"""Blends of models and timeframes, uncertainty, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import argmax3, conviction, log_odds_blend, signal_score

P = ("prob_up", "prob_flat", "prob_down")


def combine_models(predictions: DataFrame, sharpes: DataFrame | None = None) -> DataFrame:
    """Per (symbol, interval, ts): probabilities weighted by the models' Sharpe ratios (0.01 at least; equal without), the
    weighted magnitude, agreement (share of the commonest class) and uncertainty: the probabilities' mean deviation over
    classes and the mean of the models' own `uncertainty`, 0 if they have none. A single model's row stays as it is."""
    if "uncertainty" not in predictions.columns:
        predictions = predictions.withColumn("uncertainty", F.lit(0.0))
    d = predictions if sharpes is None else predictions.join(sharpes.select("model", "sharpe"), "model", "left")
    w = F.lit(1.0) if sharpes is None else F.greatest(F.coalesce("sharpe", F.lit(0.01)), F.lit(0.01))
    d = d.withColumns({"_w": w, "_c": argmax3(*P)})
    n = F.count(F.lit(1))
    sums = [(F.sum(F.col("_w") * F.col(p)) / F.sum("_w")).alias(f"_{p}") for p in P]
    votes = F.greatest(*[F.count_if(F.col("_c") == c) for c in ("UP", "FLAT", "DOWN")])
    spread = sum((F.stddev_pop(p) for p in P), F.lit(0.0)) / 3 + F.avg("uncertainty")
    g = d.groupBy("symbol", "interval", "ts").agg(*sums, (F.sum(F.col("_w") * F.col("magnitude")) / F.sum("_w")).alias("magnitude"), (votes / n).alias("agreement"), spread.alias("uncertainty"), n.alias("models"))
    total = F.col("_prob_up") + F.col("_prob_flat") + F.col("_prob_down") + 1e-10
    g = g.withColumns({p: F.when(F.col("models") == 1, F.col(f"_{p}")).otherwise(F.col(f"_{p}") / total) for p in P}).drop(*[f"_{p}" for p in P])
    return g.withColumn("direction", argmax3(*P)).withColumn("score", signal_score(*P, "magnitude", "uncertainty"))


def sample_uncertainty(samples: DataFrame, item: list[str]) -> DataFrame:
    """Over sampled probability vectors of an item: mean probabilities, mean deviation, entropy of the mean, mutual information."""
    h = lambda ps: sum((F.when(p > 0, -p * F.log(p)).otherwise(0.0) for p in ps), F.lit(0.0))
    d = samples.withColumn("_h", h([F.col(p) for p in P]))
    g = d.groupBy(*item).agg(*[F.avg(p).alias(p) for p in P], (sum((F.stddev_pop(p) for p in P), F.lit(0.0)) / 3).alias("std_prob"), F.stddev_pop("magnitude").alias("std_magnitude"), F.avg("_h").alias("_mh"))
    g = g.withColumn("entropy", h([F.col(p) for p in P]))
    return g.withColumn("mutual_information", F.col("entropy") - F.col("_mh")).drop("_mh")


def adaptive_weights(primary: Column, secondary: Column) -> tuple[Column, Column]:
    """In proportion to the accuracies; 0.6 and 0.4 without any."""
    total = F.coalesce(primary, F.lit(0.0)) + F.coalesce(secondary, F.lit(0.0))
    a = F.when(total > 0, F.coalesce(primary, F.lit(0.0)) / F.nullif(total, F.lit(0.0))).otherwise(0.6)
    return a, 1 - a


def agreement_label(dir_a, dir_b, mag_a, mag_b, pullback: float = 0.01) -> Column:
    """How the shorter timeframe b stands to a: STRONG and a's direction where both go that way, BOTH FLAT, WEAK where only a
    moves, TIMING where only b does; of opposite moves PULLBACK if only b's is small (under `pullback`), TIMING if only a's
    is, else CONFLICT."""
    a, b = F.col(dir_a), F.col(dir_b)
    small_a, small_b = F.abs(mag_a) < pullback, F.abs(mag_b) < pullback
    of = lambda word, side: F.concat(F.lit(f"{word} "), side)
    same = F.when(a == "FLAT", "BOTH FLAT").otherwise(of("STRONG", a))
    opposite = F.when(small_b & ~small_a, of("PULLBACK", a)).when(small_a & ~small_b, of("TIMING", b)).otherwise("CONFLICT")
    return F.when(a == b, same).when(b == "FLAT", of("WEAK", a)).when(a == "FLAT", of("TIMING", b)).otherwise(opposite)


def agreement(label: Column) -> Column:
    """STRONG, CONFLICT or PARTIAL, of a label."""
    return F.when(label.startswith("STRONG"), "STRONG").when(label == "CONFLICT", "CONFLICT").otherwise("PARTIAL")


def combine_timeframes(primary: DataFrame, secondary: DataFrame, wa=0.6, wb=0.4, on: tuple = ("symbol", "ts")) -> DataFrame:
    """Inner join of both timeframes (of repeated secondaries the last): log-odds blend, magnitude, conviction (the root of
    both convictions' product), agreement with its label, and score, which goes by the blend's own conviction. Partial
    agreement keeps the score, strong raises it by half, conflict leaves three tenths."""
    cols = [*P, "magnitude", "direction"]
    a = primary.select(*on, *[F.col(c).alias(f"a_{c}") for c in cols])
    b = secondary.groupBy(*on).agg(F.max_by(F.struct(*cols), "at").alias("b")).select(*on, *[F.col(f"b.{c}").alias(f"b_{c}") for c in cols])
    d = a.join(b, list(on))
    blend = log_odds_blend([f"a_{p}" for p in P], [f"b_{p}" for p in P], wa, wb)
    d = d.withColumns(dict(zip(P, blend, strict=True)))
    d = d.withColumns({"direction": argmax3(*P), "magnitude": wa * F.col("a_magnitude") + wb * F.col("b_magnitude"), "agreement_label": agreement_label("a_direction", "b_direction", "a_magnitude", "b_magnitude")})
    d = d.withColumn("agreement", agreement(F.col("agreement_label")))
    d = d.withColumn("conviction", F.sqrt(conviction(*[f"a_{p}" for p in P]) * conviction(*[f"b_{p}" for p in P])))
    boost = F.when(F.col("agreement") == "STRONG", 1.5).when(F.col("agreement") == "PARTIAL", 1.0).otherwise(0.3)
    return d.withColumn("score", signal_score(*P, "magnitude") * boost)


def ranked(signals: DataFrame, n: int = 10, by: tuple = ("ts",), state: Column | None = None) -> DataFrame:
    """The strongest n signals of each time by score, with their rank, ties by symbol. The drawdown state, where given, leaves
    none of them in HALTED and half of them, one at least, in REDUCED."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round("score", 9)), "symbol"))
    allowed = F.lit(n) if state is None else F.when(state == "HALTED", 0).when(state == "REDUCED", max(1, n // 2)).otherwise(n)
    return signals.withColumn("rank", rank).where(F.col("rank") <= allowed)


def breadth(predictions: DataFrame, by: list[str]) -> DataFrame:
    return predictions.groupBy(*by).agg(*[F.count_if(F.col("direction") == c).alias(f"n_{c.lower()}") for c in ("UP", "DOWN", "FLAT")])


def decayed_performance(scores: DataFrame, key: list[str], value: str = "value", decay: float = 0.95) -> DataFrame:
    """(key, n, score): s <- decay s + (1 - decay) value in time order, from the first value."""
    from tidemark.functions.recursive import Smooth, smooth

    d = smooth(scores.withColumn(value, F.col(value).cast("double")), [Smooth(value, "_s", 1 - decay)], tuple(key))
    return d.groupBy(*key).agg(F.count(value).alias("n"), F.max_by("_s", "ts").alias("score"))


def performance_summary(performance: DataFrame) -> DataFrame:
    """Per model: mean and population deviation of its scores over symbols and regimes, and records."""
    return performance.groupBy("model").agg(F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"), F.sum("n").alias("records"))


def selected_models(performance: DataFrame, least: int = 10) -> DataFrame:
    """(symbol, regime, model) for every symbol and regime: the best with enough records, else the best by mean score."""
    top = performance_summary(performance).agg(F.max_by("model", F.struct(F.round("mean_score", 9), "model")).alias("_top"))
    every = performance.select("symbol", "regime").distinct()
    d = every.join(best_models(performance, least), ["symbol", "regime"], "left").crossJoin(F.broadcast(top))  # one row
    return d.select("symbol", "regime", F.coalesce("model", "_top").alias("model"))


def best_models(performance: DataFrame, least: int = 10) -> DataFrame:
    """(symbol, regime, model): the best score with enough records."""
    return performance.where(F.col("n") >= least).groupBy("symbol", "regime").agg(F.max_by("model", F.struct("score", "model")).alias("model"), F.max("score").alias("score"))
