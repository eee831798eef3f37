"""Models that stay on Spark: boosting, batch scoring, permutation importance, fold means, symbol clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import series


def _assembled(rows: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="_features").transform(rows.fillna(0.0, subset=features))


def fit_boosting(rows: DataFrame, features: list[str], label: str = "label", magnitude: str = "forward_pct", iterations: int = 10, depth: int = 4, seed: int = 42):
    """A direction model (one boosted classifier against the rest for each class) and a magnitude model."""
    from pyspark.ml.classification import GBTClassifier, OneVsRest
    from pyspark.ml.regression import GBTRegressor

    d = _assembled(rows.where(F.col(label).isNotNull()), features).withColumn(label, F.col(label).cast("double"))
    direction = OneVsRest(classifier=GBTClassifier(maxIter=iterations, maxDepth=depth, seed=seed), featuresCol="_features", labelCol=label).fit(d)
    size = GBTRegressor(featuresCol="_features", labelCol=magnitude, maxIter=iterations, maxDepth=depth, seed=seed).fit(d)
    return direction, size


def score(models, rows: DataFrame, features: list[str]) -> DataFrame:
    """rows with prob_up, prob_flat, prob_down, magnitude and direction: sigmoid of twice each raw score, renormalised."""
    from pyspark.ml.functions import vector_to_array

    from tidemark.functions.columns import argmax3

    direction, size = models
    d = size.transform(_assembled(rows, features)).withColumnRenamed("prediction", "magnitude")
    d = direction.transform(d).withColumn("_raw", vector_to_array("rawPrediction"))
    p = [1 / (1 + F.exp(-2 * F.get("_raw", i))) for i in range(3)]
    total = p[0] + p[1] + p[2]
    d = d.withColumns(dict(zip(("prob_up", "prob_flat", "prob_down"), (x / total for x in p), strict=True)))
    return d.withColumn("direction", argmax3("prob_up", "prob_flat", "prob_down")).drop("_features", "_raw", "rawPrediction", "prediction")


def permuted(rows: DataFrame, features: list[str], repeats: int) -> DataFrame:
    """rows with partners, an array with the features of another row of its series for each repeat: in an order that a hash
    of the time gives, the row so many places on, around the end. Over a series that deals each feature's values anew, as a
    shuffle does. One window a series; rows grow by their partners and are not copied."""
    mark = F.md5(F.col("ts").cast("string").cast("binary"))
    w = Window.partitionBy("symbol", "interval").orderBy(mark, "ts")
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v, n, at = F.struct(*features), F.col("_n"), F.col("_i")
    d = rows.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy("symbol", "interval"))})
    d = d.withColumns({"_first": F.array(*[F.nth_value(v, k).over(all_) for k in range(1, repeats + 1)])} | {f"_v{k}": F.lead(v, k).over(w) for k in range(1, repeats + 1)})
    partner = [F.when(at + k < n, F.col(f"_v{k}")).otherwise(F.get("_first", F.pmod(at + k, n).cast("int"))) for k in range(1, repeats + 1)]
    return d.withColumn("partners", F.array(*partner)).drop("_i", "_n", "_first", *[f"_v{k}" for k in range(1, repeats + 1)])


def prediction_loss(label: Column, prob_up: Column, prob_flat: Column, prob_down: Column, magnitude: Column, actual: Column) -> Column:
    """Cross entropy of the class (0 UP, 1 FLAT, else DOWN) and Huber loss (delta 1) of the magnitude, summed."""
    own = F.when(label == 0, prob_up).when(label == 1, prob_flat).otherwise(prob_down)
    off = F.abs(magnitude - actual)
    return -F.log(F.greatest(own, F.lit(1e-15))) + F.when(off <= 1, off * off / 2).otherwise(off - 0.5)


def permutation_importance(models, rows: DataFrame, features: list[str], repeats: int = 5, actual: str = "forward_pct") -> DataFrame:
    """(feature_name, importance): how much the loss rises, on average, when a feature's values are shuffled within each
    series. models are fit_boosting's, or a function that adds score()'s columns to rows.

    Scored in one pass: a row is scored as it is and once for each feature and repeat with its partner's value, made in the
    stage that scores it and shuffled by none; what a task adds up is two numbers a feature."""
    predict = models if callable(models) else lambda d: score(models, d, features)
    d = permuted(rows.where(F.col("label").isNotNull() & F.col(actual).isNotNull()), features, repeats)
    own = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit(0).alias("k")))
    each = F.array(*[F.struct(F.lit(f).alias("name"), F.lit(k).alias("k")) for f in features for k in range(repeats)])
    d = d.withColumn("_c", F.explode(F.concat(own, each)))
    d = d.withColumns({f: F.when(F.col("_c.name") == f, F.get("partners", F.col("_c.k"))[f]).otherwise(F.col(f)) for f in features}).withColumn("feature_name", F.col("_c.name"))
    loss = prediction_loss(F.col("label"), *[F.col(c) for c in ("prob_up", "prob_flat", "prob_down", "magnitude")], F.col(actual))
    g = predict(d.drop("partners", "_c")).groupBy("feature_name").agg(F.avg(loss).alias("loss"))
    base = g.where("feature_name IS NULL").select(F.col("loss").alias("base"))
    return g.where("feature_name IS NOT NULL").crossJoin(F.broadcast(base)).select("feature_name", (F.col("loss") - F.col("base")).alias("importance"))  # one row


def fold_means(predictions: DataFrame, item: list[str]) -> DataFrame:
    """Mean over fold models of each item's probabilities and magnitude."""
    return predictions.groupBy(*item).agg(*[F.avg(c).alias(c) for c in ("prob_up", "prob_flat", "prob_down", "magnitude")], F.count(F.lit(1)).alias("folds"))


def symbol_statistics(returns: DataFrame, value: str = "ret", n: int = 500, least: int = 50) -> DataFrame:
    """Per symbol, of its newest n returns: count, mean, deviation, raw third and fourth moments scaled, autocorrelation."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    r = returns.where(F.col(value).isNotNull()).withColumn("_b", back).where(F.col("_b") <= n)
    r = r.withColumn("_lag", F.lag(value).over(series("symbol")))
    x, sd = F.col(value), F.stddev_pop(value)
    g = r.groupBy("symbol").agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), sd.alias("std"), (F.avg(x * x * x) / (F.pow(sd, F.lit(3.0)) + 1e-10)).alias("skew"), (F.avg(x * x * x * x) / (F.pow(sd, F.lit(4.0)) + 1e-10)).alias("kurtosis"), F.corr(value, "_lag").alias("autocorrelation")
    )
    return g.where(F.col("n") >= least)


def clusters(stats: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """stats with the cluster of each symbol, by k-means over standardised statistics; 0 for all if they are fewer than k."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler

    if stats.limit(k).count() < k:
        return stats.withColumn("cluster", F.lit(0))
    names = ["mean", "std", "skew", "kurtosis", "autocorrelation"]
    d = _assembled(stats, names)
    d = StandardScaler(inputCol="_features", outputCol="_x", withMean=True).fit(d).transform(d)
    return KMeans(featuresCol="_x", predictionCol="cluster", k=k, seed=seed).fit(d).transform(d).drop("_features", "_x")


def feature_correlations(rows: DataFrame, features: list[str], threshold: float = 0.95) -> DataFrame:
    """(a, b, r) of feature pairs whose absolute correlation passes the threshold, each over the rows that have both; NaN
    counts as missing. Pairs with a constant side have none.

    Two passes whatever the number of features: their means, then each task's sums of products of all pairs as matrix
    products, added up by pair."""
    means = rows.agg(*[F.avg(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double"))).alias(f) for f in features]).first()
    centre = np.array([means[f] or 0.0 for f in features])
    i, j = np.triu_indices(len(features), 1)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, len(features), len(features)))
        for batch in batches:
            x = batch.to_numpy(float) - centre
            has = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            total += [has.T @ has, x.T @ has, has.T @ x, (x * x).T @ has, has.T @ (x * x), x.T @ x]
        yield pd.DataFrame({"i": i, "j": j} | {n: total[k][i, j] for k, n in enumerate(("n", "sx", "sy", "sxx", "syy", "sxy"))})

    names = F.array(*map(F.lit, features))
    d = rows.select(*[F.col(f).cast("double").alias(f) for f in features]).mapInPandas(sums, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
    d = d.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    spread = lambda s, ss: F.col("n") * F.col(ss) - F.col(s) * F.col(s)
    both = F.sqrt(spread("sx", "sxx") * spread("sy", "syy"))
    r = F.when((spread("sx", "sxx") > 0) & (spread("sy", "syy") > 0), (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / both)
    return d.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), r.alias("r")).where(F.abs("r") > threshold).withColumn("r", F.round("r", 4))


def score_with(rows: DataFrame, features: list[str], load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, batch: int = 4096) -> DataFrame:
    """rows with the columns of schema (all double) that a model from elsewhere gives: load() returns its predict function, of
    a pandas frame of the features (a missing one is 0) to a frame with as many rows. A Python worker loads the model once
    and keeps it for all its batches and tasks."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).names

    def make():
        predict = load()

        def run(x: np.ndarray) -> dict[str, np.ndarray]:
            out = predict(pd.DataFrame(x, columns=features))
            if len(out) != len(x):
                raise ValueError(f"{len(out)} predictions of {len(x)} rows")
            return {c: out[c].to_numpy(float) for c in names}

        return run

    run = predict_batch_udf(make, return_type=StructType.fromDDL(schema), batch_size=batch, input_tensor_shapes=[[len(features)]])
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    return rows.withColumn("_p", run(x)).select(*rows.columns, "_p.*")
