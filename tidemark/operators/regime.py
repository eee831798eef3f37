"""Market regimes of a leader's candles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import pct, rolling

#: Score factor, conviction change and threshold change of each regime.
ADJUSTMENTS = {"UP": (1.2, 0.1, 0.0), "DOWN": (1.0, 0.05, 0.0), "RANGING": (0.7, -0.1, 0.002), "HIGH_VOL": (0.5, -0.15, 0.003)}


def features(bars: DataFrame) -> DataFrame:
    """bars with ret1, ret4, vol24, trend and volume_change."""
    d = bars.withColumns({"_r1": pct("close", 1), "_r4": pct("close", 4)})
    d = d.withColumns({"ret1": F.coalesce("_r1", F.lit(0.0)), "ret4": F.coalesce("_r4", F.lit(0.0)), "vol24": F.coalesce(rolling(F.stddev_samp, "_r1", 24), F.lit(1e-10)), "_m": rolling(F.avg, "_r1", 48)})
    d = d.withColumns({"trend": F.coalesce(F.try_divide(F.abs("_m"), F.col("vol24")), F.lit(0.0)), "volume_change": F.greatest(F.lit(-5.0), F.least(F.lit(5.0), F.coalesce(pct("volume"), F.lit(0.0))))})
    return d.drop("_r1", "_r4", "_m")


def classified(f: DataFrame, vol: float = 0.03, ret: float = 0.005) -> DataFrame:
    """features with the rule-based regime."""
    return f.withColumn("regime", F.when(F.col("vol24") > vol, "HIGH_VOL").when(F.col("ret1") > ret, "UP").when(F.col("ret1") < -ret, "DOWN").otherwise("RANGING"))


def fitted(f: DataFrame, states: int = 4, seed: int = 42) -> DataFrame:
    """features with a mixture model's state and its regime name: the state with the most volatility, then the highest
    mean return, then the lowest, each naming over the ones before; the rest is ranging."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    names = ["ret1", "ret4", "vol24", "trend", "volume_change"]
    d = VectorAssembler(inputCols=names, outputCol="_raw").transform(f)
    d = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(d).transform(d)
    d = GaussianMixture(featuresCol="_x", predictionCol="state", probabilityCol="_p", k=states, seed=seed).fit(d).transform(d).drop("_raw", "_x", "_p")
    return named(d)


def named(d: DataFrame) -> DataFrame:
    s = d.groupBy("state").agg(F.avg("vol24").alias("_v"), F.avg("ret1").alias("_r"))
    top = s.agg(F.max_by("state", "_v").alias("_hv"), F.max_by("state", "_r").alias("_up"), F.min_by("state", "_r").alias("_dn"))
    x = d.crossJoin(F.broadcast(top))  # one row
    regime = F.when(F.col("state") == F.col("_dn"), "DOWN").when(F.col("state") == F.col("_up"), "UP").when(F.col("state") == F.col("_hv"), "HIGH_VOL").otherwise("RANGING")
    return x.withColumn("regime", regime).drop("_hv", "_up", "_dn")


def adjusted(signals: DataFrame, regime: str = "regime") -> DataFrame:
    """signals(score, conviction) with both adjusted and threshold_change."""
    pick = lambda i: F.coalesce(*[F.when(F.col(regime) == k, F.lit(v[i])) for k, v in ADJUSTMENTS.items()], F.lit((1.0, 0.0, 0.0)[i]))
    return signals.withColumns({"score": F.col("score") * pick(0), "conviction": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("conviction") + pick(1))), "threshold_change": pick(2)})
