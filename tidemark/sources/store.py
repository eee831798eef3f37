"""Keyed tables on Parquet: first write wins, last write wins, outcome updates, back-fills, planning."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def new_rows(batch: DataFrame, target: DataFrame | None, key: list[str], arrival: str | None = None) -> DataFrame:
    """Rows of the batch whose key is neither stored nor earlier in the batch (by the arrival column): first write wins."""
    order = F.col(arrival) if arrival else F.lit(0)
    d = batch.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_r = 1").drop("_r")
    return d if target is None else d.join(target.select(*key), key, "left_anti")


#: Partition values of a batch up to which a read of stored keys names them, so that other partitions are not listed.
MOST_PARTITIONS = 1000


def _touched(target: DataFrame, batch: DataFrame, partition_by: list[str]) -> DataFrame:
    """The rows of target in the partitions that the batch has rows for: by a filter on partition columns alone, which prunes
    files before any is read; of a batch over very many partitions by a semi-join."""
    values = batch.select(*partition_by).distinct().limit(MOST_PARTITIONS + 1).collect() if partition_by else []
    if len(values) > MOST_PARTITIONS:
        return target.join(batch.select(*partition_by).distinct(), partition_by, "left_semi")
    if len(partition_by) == 1 and all(v[0] is not None for v in values):
        return target.where(F.col(partition_by[0]).isin([v[0] for v in values]))
    same = [reduce(and_, (F.col(c).eqNullSafe(F.lit(v[c])) for c in partition_by)) for v in values]
    return target.where(reduce(or_, same)) if same else target


def append_new(batch: DataFrame, path: str, key: list[str], partition_by: list[str], arrival: str | None = None) -> int:
    """Appends the batch's new rows to a partitioned Parquet table and returns how many there were, as the write counts them.
    Stored keys are read from the partitions alone that the batch touches. One writer at a time: two could both find a key
    new."""
    spark = batch.sparkSession
    target = None
    if exists(spark, path):
        target = spark.read.parquet(path)
        target = target.withColumns({c: F.col(c).cast(batch.schema[c].dataType) for c in partition_by})
        target = _touched(target, batch, partition_by)
    written = Observation()
    fresh = new_rows(batch, target, key, arrival).observe(written, F.count(F.lit(1)).alias("rows"))
    fresh.write.mode("append").partitionBy(*partition_by).parquet(path)
    return written.get["rows"]


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def batches_done(spark: SparkSession, path: str) -> DataFrame | None:
    """(stream, batch_id, rows, at): the batches of streams that the table at path has taken in; None before the first. The
    folder's name begins with an underscore, so readers of the table don't see it."""
    ledger = f"{path}/_batches"
    return spark.read.parquet(ledger) if exists(spark, ledger) else None


def take_batch(batch: DataFrame, batch_id: int, path: str, key: list[str], partition_by: list[str], stream: str, arrival: str | None = None) -> int:
    """append_new for a micro-batch of a stream, once: a batch that the ledger has is a replay and is dropped. A batch that
    was written but not entered, as when the driver was lost between the two, finds its keys stored and adds none twice.
    Returns the number of new rows."""
    spark = batch.sparkSession
    done = batches_done(spark, path)
    if done is not None and not done.where((F.col("stream") == stream) & (F.col("batch_id") == batch_id)).isEmpty():
        return 0
    batch = batch.persist()
    try:
        rows = append_new(batch, path, key, partition_by, arrival)
    finally:
        batch.unpersist()
    entry = spark.range(1).select(F.lit(stream).alias("stream"), F.lit(batch_id).cast("long").alias("batch_id"), F.lit(rows).cast("long").alias("rows"), F.current_timestamp().alias("at"))
    entry.coalesce(1).write.mode("append").parquet(f"{path}/_batches")
    return rows


def upserted(target: DataFrame, batch: DataFrame, key: list[str], version: str) -> DataFrame:
    """Target and batch with the highest version of each key; columns that the newer row lacks become NULL."""
    both = target.unionByName(batch, allowMissingColumns=True)
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(version)))).where("_r = 1").drop("_r")


def updated_outcomes(predictions: DataFrame, outcomes: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    new = outcomes.select(*key, *[F.col(c).alias(f"_{c}") for c in columns])
    d = predictions.join(new, key, "left")
    return d.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c) if c in predictions.columns else F.lit(None)) for c in columns}).drop(*[f"_{c}" for c in columns])


def between(side: DataFrame, start: Column | None, end: Column | None, limit: int | None = None, by: str = "symbol") -> DataFrame:
    """Rows with start <= ts <= end, the earliest `limit` of each symbol."""
    d = side if start is None else side.where(F.col("ts") >= start)
    d = d if end is None else d.where(F.col("ts") <= end)
    if limit is None:
        return d
    return d.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy("ts"))).where(F.col("_r") <= limit).drop("_r")


def back_filled(old: DataFrame, columns: dict[str, str], interval: str = "60") -> DataFrame:
    """An old table in today's schema: a missing interval becomes '60', other missing columns NULL of their type."""
    d = old if "interval" in old.columns else old.withColumn("interval", F.lit(interval))
    return d.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in d.columns})


def backfill_plan(symbols: DataFrame, bars: DataFrame, interval: str, total: int) -> DataFrame:
    """(symbol, existing, remaining) for symbols that lack candles; a quarter-hour interval needs four times as many."""
    need = total * 4 if interval == "15" else total
    have = bars.where(F.col("interval") == interval).groupBy("symbol").agg(F.count(F.lit(1)).alias("existing"))
    d = symbols.select("symbol").distinct().join(have, "symbol", "left").withColumn("existing", F.coalesce("existing", F.lit(0).cast("long")))
    return d.withColumn("remaining", need - F.col("existing")).where("remaining > 0")
