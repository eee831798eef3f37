"""Long series in pieces: windows over a bounded number of rows, parallel inside one symbol.

Row numbers are made without a window over a whole series (counts of time buckets give each bucket's offset), so a series of
any length is cut into pieces of equal size, each with the last rows of the piece before it as a halo."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import KEY, seconds


def _bucketed(rows: DataFrame, bucket: str) -> DataFrame:
    at = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    return rows.withColumn("_b", F.floor(at / seconds(bucket)))


def running_totals(rows: DataFrame, totals: dict[str, str], bucket: str = "1 day", key: tuple = KEY) -> DataFrame:
    """rows with, for each {out: x}, the sum of x over the series up to the row, in two levels: running sums inside time
    buckets, and what all buckets before hold, from a row a bucket. No task sees more than a bucket's rows of a series; a
    NULL counts as nothing, and as in a window's sum the total is NULL before the first value. Rows without time or key
    form buckets of their own."""
    d = _bucketed(rows, bucket)
    before = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = d.groupBy(*key, "_b").agg(*[F.sum(x).alias(f"_t{i}") for i, x in enumerate(totals.values())])
    offsets = offsets.select(F.struct(*key, "_b").alias("_of"), *[F.sum(f"_t{i}").over(before).alias(f"_o{i}") for i in range(len(totals))])
    inside = Window.partitionBy(*key, "_b").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"_t{i}": F.sum(x).over(inside) for i, x in enumerate(totals.values())}).withColumn("_of", F.struct(*key, "_b"))
    d = d.join(offsets, "_of")  # structs compare their NULLs as equal
    zero = F.lit(0.0)
    whole = lambda i: F.when(F.col(f"_o{i}").isNotNull() | F.col(f"_t{i}").isNotNull(), F.coalesce(f"_o{i}", zero) + F.coalesce(f"_t{i}", zero))
    d = d.withColumns({out: whole(i) for i, out in enumerate(totals)})
    return d.drop("_of", "_b", *[f"{c}{i}" for c in ("_t", "_o") for i in range(len(totals))])


def numbered(rows: DataFrame, out: str = "_n", bucket: str = "1 day", key: tuple = KEY) -> DataFrame:
    """rows with their number (from 0) in their series by time; no task sees more than a bucket's rows of a series."""
    d = _bucketed(rows, bucket)
    before = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    offsets = d.groupBy(*key, "_b").agg(F.count(F.lit(1)).alias("_c")).withColumn("_o", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    inside = F.row_number().over(Window.partitionBy(*key, "_b").orderBy("ts"))
    return d.withColumn("_i", inside).join(offsets, [*key, "_b"]).withColumn(out, F.col("_o") + F.col("_i") - 1).drop("_b", "_i", "_o")


def in_pieces(rows: DataFrame, f: Callable[[DataFrame], DataFrame], halo: int, size: int = 50_000, bucket: str = "1 day") -> DataFrame:
    """f(rows), where f adds columns that need `halo` rows before a row at most and keeps the others. Each piece of a series
    goes through f as a series of its own, by a name that the interval carries; the halo rows are dropped after."""
    size = max(size, halo)
    d = numbered(rows, bucket=bucket)
    own = F.floor(F.col("_n") / size)
    again = F.when(F.col("_n") % size >= size - halo, F.array(own, own + 1)).otherwise(F.array(own))
    d = d.withColumn("_p", F.explode(again)).withColumn("_real", F.col("_p") == own)
    d = f(d.withColumn("interval", F.concat_ws("#", "interval", "_p")))
    return d.where("_real").withColumn("interval", F.substring_index("interval", "#", 1)).drop("_n", "_p", "_real")
