"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_folder, ship

#: Rows of one Arrow batch that goes to a Python worker; at 120 KB a text this is 30 MB.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bounds what a Python worker holds at once, and sees to it that workers have this package. There is no such bound for
    one function alone, so the session's is set, but only where it has Spark's default: a caller's own setting stays."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores after it as keep it apart from every column of df (case doesn't count)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows whose labels no model sees: crc32 of the id as text, modulo folds, is 0 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


#: Paths of the tables that written() has made and that are still there.
MADE: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: it is computed once, its lineage ends there and it outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    MADE.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tidemark_path = path
    return out


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables of written(), once nothing reads them any more: after an operator's result has been written, say."""
    for path in list(paths):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        MADE.remove(path)


def drop_written(df: DataFrame) -> None:
    drop_tables(df.sparkSession, [df.tidemark_path])


def with_row_key(docs: DataFrame, key: str = "_key") -> DataFrame:
    """Adds a 64-bit key of (doc_id, text): rows that agree in both share it and get the same result."""
    return docs.withColumn(key, F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))))
