"""Accuracy reports, sample weights, threshold grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import direction

CLASSES = ("UP", "DOWN", "FLAT")


def scored_since(predictions: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return predictions.where(F.col("scored_at") >= as_of - F.make_interval(days=F.lit(days)))


def unscored(predictions: DataFrame) -> DataFrame:
    return predictions.where("scored_at IS NULL AND ts IS NOT NULL")


def accuracy_report(scored: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    """One row, or one for each value of by (the days of an accuracy log, say): total_preds, direction_accuracy, magnitude_mae, precision and recall of each class. Actual classes are made
    anew with the current threshold."""
    d = scored.withColumn("_a", direction("actual_magnitude", threshold))
    hit = F.col("_a") == F.col("direction")
    aggs = [F.count(F.lit(1)).alias("total_preds"), F.avg(hit.cast("double")).alias("direction_accuracy"), F.avg(F.abs(F.col("magnitude") - F.col("actual_magnitude"))).alias("magnitude_mae")]
    for c in CLASSES:
        both = F.count_if((F.col("_a") == c) & (F.col("direction") == c))
        aggs.append(F.coalesce(F.try_divide(both, F.count_if(F.col("direction") == c)), F.lit(0.0)).alias(f"{c.lower()}_precision"))
        aggs.append(F.coalesce(F.try_divide(both, F.count_if(F.col("_a") == c)), F.lit(0.0)).alias(f"{c.lower()}_recall"))
    return d.groupBy(*(by or [])).agg(*aggs).withColumn("flat_threshold_used", F.lit(threshold))


def best_and_worst(scored: DataFrame, n: int = 5, least: int = 3) -> DataFrame:
    """(symbol, n_preds, hit_rate, best_rank, worst_rank): the n best and n worst symbols by stored was_correct."""
    s = scored.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_preds"), F.avg(F.col("was_correct").cast("double")).alias("hit_rate")).where(F.col("n_preds") >= least)
    up, down = Window.orderBy(F.desc("hit_rate"), "symbol"), Window.orderBy("hit_rate", "symbol")  # a row a symbol
    return s.withColumns({"best_rank": F.row_number().over(up), "worst_rank": F.row_number().over(down)}).where((F.col("best_rank") <= n) | (F.col("worst_rank") <= n))


def daily_accuracy(scored: DataFrame) -> DataFrame:
    hit = F.count_if("was_correct")
    return scored.groupBy("interval", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("total"), hit.alias("correct"), F.round(100 * hit / F.count(F.lit(1)), 1).alias("pct"))


def interval_accuracy(scored: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """(interval, n, accuracy) of what was scored in the last days; intervals without any have no row."""
    return scored_since(scored, as_of, days).groupBy("interval").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(F.col("was_correct").cast("double"), F.lit(0.0))).alias("accuracy"))


def accuracy_history(log: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """The accuracy log's entries of the last days, newest first."""
    return log.where(F.col("run_date") >= F.date_sub(as_of.cast("date"), days)).orderBy(F.desc("run_date"))


def sample_weights(scored: DataFrame, least: int = 5, most: float = 5.0) -> DataFrame:
    """(symbol, n_preds, error_rate, weight): 1 + error over the mean error of the symbols kept, at most `most`."""
    s = scored.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_preds"), (1 - F.avg(F.col("was_correct").cast("double"))).alias("error_rate")).where(F.col("n_preds") >= least)
    mean = F.avg("error_rate").over(Window.partitionBy())  # a row a symbol
    return s.withColumn("weight", F.when(mean > 0, F.least(F.lit(most), 1 + F.col("error_rate") / mean)).otherwise(1.0))


def with_default_weight(rows: DataFrame, weights: DataFrame) -> DataFrame:
    return rows.join(weights.select("symbol", "weight"), "symbol", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def grid(low: float, high: float, n: int) -> Column:
    """n thresholds, evenly spaced, as an array."""
    return F.array(*[F.lit(low + (high - low) * i / (n - 1)) for i in range(n)])


def threshold_grid(scored: DataFrame, split: Column, low: float = 0.002, high: float = 0.015, n: int = 50) -> DataFrame:
    """(threshold, split, rows, accuracy) for each threshold: rows are multiplied in a narrow stage and pre-aggregated, so
    two rows a threshold and task are shuffled."""
    d = scored.where("actual_magnitude IS NOT NULL AND magnitude IS NOT NULL").select("magnitude", "actual_magnitude", split.alias("split"), F.explode(grid(low, high, n)).alias("threshold"))
    hit = direction("magnitude", F.col("threshold")) == direction("actual_magnitude", F.col("threshold"))
    return d.groupBy("threshold", "split").agg(F.count(F.lit(1)).alias("rows"), F.avg(hit.cast("double")).alias("accuracy"))


def optimal_threshold(scored: DataFrame, split: Column, current: float, low: float = 0.002, high: float = 0.015, n: int = 50, least: int = 20, keep: float = 0.7) -> DataFrame:
    """One row: rows, best, tune_accuracy, eval_accuracy, current_accuracy, threshold. The first best threshold on the tune
    split is taken over if it beats the current one on the eval split, and blended in."""
    g = threshold_grid(scored, split, low, high, n)
    tune, ev = g.where("split = 'tune'"), g.where("split = 'eval'").select("threshold", F.col("accuracy").alias("eval_accuracy"))
    best = tune.orderBy(F.desc("accuracy"), "threshold").limit(1).select("threshold", F.col("accuracy").alias("tune_accuracy"))
    now = direction("magnitude", current) == direction("actual_magnitude", current)
    cur = scored.withColumn("split", split).where("actual_magnitude IS NOT NULL").agg(F.count(F.lit(1)).alias("rows"), F.avg(F.when((F.col("split") == "eval"), now.cast("double"))).alias("current_accuracy"))
    out = best.join(ev, "threshold").crossJoin(cur)  # one row each
    new = F.greatest(F.lit(low), F.least(F.lit(high), (1 - keep) * F.col("threshold") + keep * current))
    ok = (F.col("rows") >= least) & (F.col("eval_accuracy") > F.col("current_accuracy"))
    return out.select("rows", F.col("threshold").alias("best"), "tune_accuracy", "eval_accuracy", "current_accuracy", F.when(ok, new).otherwise(current).alias("threshold"))


def sharpe_grid(scored: DataFrame, low: float, high: float, n: int = 50, periods: float = 8760, mode: str = "reference") -> DataFrame:
    """(threshold, rows, mean_pnl, sharpe): profit is the actual move's size where it counts as UP, its negative where DOWN.
    mode "predicted" trades by the predicted magnitude's class instead of the actual one's."""
    d = scored.where("actual_magnitude IS NOT NULL").select("magnitude", "actual_magnitude", F.explode(grid(low, high, n)).alias("threshold"))
    side = direction("actual_magnitude" if mode == "reference" else "magnitude", F.col("threshold"))
    pnl = F.when(side == "UP", F.col("actual_magnitude")).when(side == "DOWN", -F.col("actual_magnitude")).otherwise(0.0)
    g = d.groupBy("threshold").agg(F.count(F.lit(1)).alias("rows"), F.avg(pnl).alias("mean_pnl"), F.stddev_samp(pnl).alias("_sd"))
    return g.withColumn("sharpe", F.when((F.col("rows") < 2) | (F.col("_sd") < 1e-10) | F.col("_sd").isNull(), 0.0).otherwise(F.try_divide(F.col("mean_pnl"), F.col("_sd")) * F.sqrt(F.lit(periods)))).drop("_sd")


def sharpe_threshold(grid: DataFrame, current: float, low: float, high: float, keep: float = 0.7, least: int = 20) -> DataFrame:
    """One row of sharpe_grid()'s: best (of equal Sharpe ratios the smallest threshold), its sharpe, and the threshold to use:
    `keep` of the current one and the rest of the best, within low and high; the current one itself while the grid has fewer
    than `least` rows."""
    best = grid.orderBy(F.desc(F.round("sharpe", 9)), "threshold").limit(1)
    new = F.greatest(F.lit(low), F.least(F.lit(high), (1 - keep) * F.col("threshold") + keep * current))
    return best.select(F.col("threshold").alias("best"), "sharpe", F.when(F.col("rows") >= least, new).otherwise(current).alias("threshold"))


def model_sharpes(versions: DataFrame, interval: str) -> DataFrame:
    """(model, sharpe) of one interval: of versions(model, interval, sharpe, updated_at) the last of each model."""
    return versions.where(F.col("interval") == interval).groupBy("model").agg(F.max_by("sharpe", "updated_at").alias("sharpe"))


def retired_features(status: DataFrame, interval: str) -> DataFrame:
    """The features of an interval that are retired, of retirement()'s rows."""
    return status.where((F.col("interval") == interval) & F.col("is_retired")).select("feature_name")


def pnl_weights(scored: DataFrame, least: int = 5) -> DataFrame:
    """(symbol, n_preds, weight): 1 + mean loss over mean gain, within 0.5 and 5; 1 for few rows."""
    m = F.abs("actual_magnitude")
    s = scored.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_preds"), F.coalesce(F.avg(F.when(~F.col("was_correct"), m)), F.lit(0.0)).alias("loss"), F.coalesce(F.avg(F.when(F.col("was_correct"), m)), F.lit(0.0)).alias("gain"))
    r = F.when(F.col("gain") > 0, F.col("loss") / F.nullif("gain", F.lit(0.0))).otherwise(2.0)
    return s.select("symbol", "n_preds", F.when(F.col("n_preds") < least, 1.0).otherwise(F.least(F.lit(5.0), F.greatest(F.lit(0.5), 1 + r))).alias("weight"))


def class_weights(labels: DataFrame, label: str = "label", most: float = 3.0) -> DataFrame:
    """(label, n, weight): inverse frequency, normalised to the number of classes, at most `most`."""
    c = labels.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    inv = 1 / F.col("n")
    return c.withColumn("weight", F.least(F.lit(most), 3 * inv / F.sum(inv).over(Window.partitionBy())))  # a row a class


def low_importance(importance: DataFrame, runs: int = 3, threshold: float = 0.001) -> DataFrame:
    """(interval, feature_name, mean_importance, n) of features below the threshold over the last runs, in each of them."""
    rank = F.dense_rank().over(Window.partitionBy("interval").orderBy(F.desc("run_date")))
    g = importance.withColumn("_r", rank).where(F.col("_r") <= runs).groupBy("interval", "feature_name").agg(F.avg("importance").alias("mean_importance"), F.count(F.lit(1)).alias("n"))
    return g.where((F.col("mean_importance") < threshold) & (F.col("n") >= runs))


def retirement(importance: DataFrame, threshold: float = 0.001, runs: int = 3) -> DataFrame:
    """(interval, feature_name, below_count, is_retired): runs below the threshold since the last good one."""
    w = Window.partitionBy("interval", "feature_name")
    last_good = F.max(F.when(F.col("importance") >= threshold, F.col("run_date"))).over(w)
    g = importance.withColumn("_g", last_good).groupBy("interval", "feature_name").agg(F.count_if(F.col("_g").isNull() | (F.col("run_date") > F.col("_g"))).alias("below_count"))
    return g.withColumn("is_retired", F.col("below_count") >= runs)


def simulated_equity(scored: DataFrame, start: float = 10_000.0, n: int = 200) -> DataFrame:
    """One row: equity after the predictions scored last, up by the predicted move of each that was right, down by half of
    it if wrong; FLAT ones, and moves that are NULL, leave it. `start` without any."""
    newest = scored.where("scored_at IS NOT NULL").orderBy(F.desc("scored_at"), "symbol").limit(n)
    move = F.coalesce(F.abs("magnitude"), F.lit(0.0))
    f = F.when(F.col("direction") == "FLAT", 1.0).when(F.col("was_correct"), 1 + move).otherwise(1 - 0.5 * move)
    # a product: of the factors' sizes through their logarithms, with the sign of how many are below 0
    product = F.exp(F.sum(F.log(F.nullif(F.abs(f), F.lit(0.0))))) * F.when(F.count_if(f < 0) % 2 == 1, -1).otherwise(1)
    return newest.agg(F.count(F.lit(1)).alias("n"), (start * F.when(F.count_if(f == 0) > 0, 0.0).otherwise(F.coalesce(product, F.lit(1.0)))).alias("equity"))
