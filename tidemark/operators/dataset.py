"""Labels, sliding windows, splits and weighted samples for training."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import KEY, direction, series

CLASS = {"UP": 0, "FLAT": 1, "DOWN": 2}


def labelled(bars: DataFrame, horizon: int = 1, threshold: float | Column = 0.005) -> DataFrame:
    """bars with forward_pct, direction and label; a close of 0 divides by 1; the last rows stay unlabelled."""
    ahead = F.lead("close", horizon).over(series())
    d = bars.withColumn("forward_pct", (ahead - F.col("close")) / F.when(F.col("close") == 0, 1.0).otherwise(F.col("close")))
    d = d.withColumn("forward_direction", direction("forward_pct", threshold))
    return d.withColumn("label", F.when(F.col("forward_direction") == "UP", 0).when(F.col("forward_direction") == "FLAT", 1).when(F.col("forward_direction") == "DOWN", 2))


def scaled_threshold(threshold: float, minutes: Column) -> Column:
    return threshold * minutes / 60


def windows(rows: DataFrame, features: list[str], n: int, label_offset: int = 1, stride: int = 1) -> DataFrame:
    """(symbol, interval, ts, label, window): for each labelled row, the n rows that end label_offset rows before it, as an
    array of feature arrays. With a stride only every stride-th row is kept, before its window is built into the output."""
    w = series().rowsBetween(-(n - 1) - label_offset, -label_offset)
    vector = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    d = rows.withColumns({"_v": vector, "_r": F.row_number().over(series())}).withColumns({"window": F.collect_list("_v").over(w)})
    return d.where((F.size("window") == n) & F.col("label").isNotNull() & (F.col("_r") % stride == 0)).select(*KEY, "ts", "label", "window")


def normalized(sample: DataFrame, window: str = "window") -> DataFrame:
    """Each feature of a window less its mean over the window, over its population deviation (0 counts as 1)."""
    w = F.col(window)
    n = F.size(w)

    def column(j: Column) -> Column:
        x = F.transform(w, lambda row: F.get(row, j))
        mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
        sd = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / n)
        return F.struct(mean.alias("m"), F.when(sd > 1e-12, sd).otherwise(1.0).alias("s"))

    d = sample.withColumn("_z", F.transform(F.sequence(F.lit(0), F.size(F.get(w, 0)) - 1), column))
    return d.withColumn(window, F.transform(w, lambda row: F.transform(row, lambda v, j: (v - F.get(F.col("_z"), j)["m"]) / F.get(F.col("_z"), j)["s"]))).drop("_z")


def flattened(sample: DataFrame, names: list[str], window: str = "window") -> DataFrame:
    """last_, mean_, std_ (population) and delta_ (last less first) of each feature over the window."""
    w = F.col(window)
    n = F.size(w)
    out = {}
    for j, name in enumerate(names):
        x = _feature(w, j)
        mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
        square = F.aggregate(F.transform(x, _squared_from(mean)), F.lit(0.0), lambda s, v: s + v) / n
        out |= {f"last_{name}": F.element_at(x, -1), f"mean_{name}": mean, f"std_{name}": F.sqrt(square), f"delta_{name}": F.element_at(x, -1) - F.get(x, 0)}
    return sample.withColumns(out)


def _feature(w: Column, j: int) -> Column:
    return F.transform(w, lambda row: F.get(row, j))


def _squared_from(mean: Column):
    return lambda v: (v - mean) * (v - mean)


def live_windows(rows: DataFrame, n: int) -> DataFrame:
    """rows that have a full window of n and whose closes in it are neither all 0 nor constant."""
    w = series().rowsBetween(-(n - 1), 0)
    ok = (F.count("close").over(w) == n) & (F.stddev_pop("close").over(w) >= 1e-8) & (F.max(F.abs("close")).over(w) > 0)
    return rows.withColumn("_ok", ok).where("_ok").drop("_ok")


def walk_forward(rows: DataFrame, folds: int = 5, start: float = 0.3, least: int = 0) -> DataFrame:
    """rows with fold and part ("train" or "val"), a copy for each fold that a row is in. Cuts are made over the distinct
    times of all symbols, numbered by days, and joined to the rows."""
    if least:
        rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*KEY))).where(F.col("_n") >= least).drop("_n")
    from tidemark.functions.chunks import numbered

    times = rows.select("ts").distinct().withColumn("_one", F.lit(1))
    n = times.agg(F.count(F.lit(1)).alias("_n"))
    times = numbered(times, "_t", key=("_one",)).crossJoin(F.broadcast(n)).withColumn("_t", F.col("_t") + 1).drop("_one")  # one row
    first = F.floor(start * F.col("_n"))
    size = F.greatest(F.lit(1), F.floor((F.col("_n") - first) / folds))
    t = times.withColumns({"_first": first, "_size": size}).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    cut = F.col("_first") + F.col("fold") * F.col("_size")
    t = t.withColumn("part", F.when(F.col("_t") <= cut, "train").when(F.col("_t") <= cut + F.col("_size"), "val")).where("part IS NOT NULL")
    return rows.join(t.select("ts", "fold", "part"), "ts")


def row_split(rows: DataFrame, share: float = 0.7) -> DataFrame:
    """rows with part: the first share of each series trains."""
    w = Window.partitionBy(*KEY)
    return rows.withColumn("part", F.when(F.row_number().over(series()) <= F.floor(share * F.count(F.lit(1)).over(w) + 1e-9), "train").otherwise("val"))


def rolling_cut(rows: DataFrame, as_of: Column, days: int, least: int) -> DataFrame:
    """Rows of the last days, of series that have enough rows before and after the cut."""
    w = Window.partitionBy(*KEY)
    d = rows.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= least).where(F.col("ts") >= as_of - F.make_interval(days=F.lit(days)))
    return d.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= least).drop("_n")


#: Mean up to which a Poisson draw is made at once; a larger one is the sum of several.
AT_ONCE = 100.0


def poisson(mean: Column, mark: Callable[[Column], Column]) -> Column:
    """A Poisson draw by inverting the distribution at u, mark's hash as a number from 0 to 1; mark takes the number of the
    part, as a mean over AT_ONCE is the sum of equal parts drawn with a hash each."""

    def part(i: Column) -> Column:
        u = F.conv(F.substring(F.md5(mark(i).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
        own = mean / F.ceil(mean / AT_ONCE)
        most = F.ceil(own + 12 * F.sqrt(own) + 20).cast("int")  # beyond it there is less than u can show
        begin = F.struct(F.exp(-own).alias("p"), F.exp(-own).alias("below"), F.lit(0).cast("long").alias("n"))

        def further(s: Column, k: Column) -> Column:
            p = s["p"] * own / k
            return F.struct(p.alias("p"), (s["below"] + p).alias("below"), (s["n"] + F.when(u >= s["below"], 1).otherwise(0)).alias("n"))

        return F.aggregate(F.sequence(F.lit(1), most), begin, further, lambda s: s["n"])

    parts = F.sequence(F.lit(1), F.ceil(mean / AT_ONCE).cast("int"))
    return F.when(mean > 0, F.aggregate(parts, F.lit(0).cast("long"), lambda s, i: s + part(i))).otherwise(0)


def weighted_sample(rows: DataFrame, weight: str = "weight", seed: str = "7") -> DataFrame:
    """Rows drawn with replacement, in proportion to weight and on average as many as there are: `draws`, a Poisson number of
    mean weight / mean weight of the interval, which is what a row's count comes to when a large table is drawn from row by
    row. It comes from a hash of the key, so reruns agree. A weight that is NULL or not above 0 is never drawn."""
    mean = rows.groupBy("interval").agg(F.avg(weight).alias("_mean"))  # a row an interval
    d = rows.join(mean, rows["interval"].eqNullSafe(mean["interval"])).drop(mean["interval"])
    number = lambda i: F.when(i == 1, F.lit(seed)).otherwise(F.concat(F.lit(f"{seed}+"), i.cast("string")))
    d = d.withColumn("_lambda", F.coalesce(F.try_divide(F.col(weight), F.col("_mean")), F.lit(0.0)))
    d = d.withColumn("draws", poisson(F.col("_lambda"), lambda i: F.concat_ws("|", number(i), "symbol", "interval", F.col("ts").cast("string"))))
    return d.where("draws > 0").select(*rows.columns, "draws")
