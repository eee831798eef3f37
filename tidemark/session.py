"""Session defaults for the jobs, and the package on the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}
_SHIPPED: set[str] = set()
_LOCAL: dict[str, str] = {}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the jobs' defaults; conf overrides them. Shuffle partitions are left to the cluster's setting."""
    builder = SparkSession.builder.appName("tidemark")
    if master:
        builder = builder.master(master)
    return builder.config(map=DEFAULTS | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package's code, once for each application, as --py-files would: functions that run in
    Python workers import it there, wherever the driver found it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session, whose executors
    are the driver, gets a new temporary one; on a cluster each machine would write to its own disk, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = context.applicationId
        found = _LOCAL[app] = _LOCAL.get(app) or f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return found.rstrip("/")


#: Paths of the tables that stored() has made and that are still there.
STORED: list[str] = []


def new_path(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, for rows that are read more than once: they are worked out once, and the
    lineage ends there."""
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    STORED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> None:
    """Removes the tables of stored(), once the results that read them have been written."""
    for path in list(STORED):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        STORED.remove(path)
