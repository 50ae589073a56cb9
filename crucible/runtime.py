"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []


def session(app: str = "crucible", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine expects; on a cluster the caller's session is used as it is."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder of our own on one machine (tests); on a cluster, whose executors don't share the
    driver's disk, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="crucible-"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], ignore_errors=True)
    return _OWN_DIR[0]


def cut(df: DataFrame) -> DataFrame:
    """The rows of df written to the shared folder, with a plan that only reads them; survives a lost executor."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: columnar, so later reads prune columns.

    The table belongs to the session and is listed in `tables_of`; `drop_written` removes what is no longer needed.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def tables_of(spark: SparkSession) -> list[str]:
    """Paths of the tables that `written` made in this application, oldest first."""
    return list(_WRITTEN.get(spark.sparkContext.applicationId, []))


def drop_written(spark: SparkSession, keep: int = 0) -> int:
    """Removes the tables that `written` made in this application, but for the `keep` latest; results that still read one can't be used afterwards."""
    paths = _WRITTEN.get(spark.sparkContext.applicationId, [])
    return drop_tables(spark, paths[: len(paths) - keep])


def drop_tables(spark: SparkSession, old: Collection[str]) -> int:
    """Removes some of the tables that `written` made in this application, by path."""
    paths = _WRITTEN.get(spark.sparkContext.applicationId, [])
    paths[:] = [p for p in paths if p not in old]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in old:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    return len(old)


def release(spark: SparkSession) -> None:
    """Asks for the removal of shuffle files of plans that nothing holds any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_WRITTEN: dict[str, list[str]] = {}


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the workers this package, once an application, also where it lies only on the driver's path."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="crucible-code-")  # the driver's; Spark hands the file to the executors
    path = os.path.join(folder, "crucible_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(os.path.join(root, "crucible")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for costly row functions over a few small files."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def gathered(df: DataFrame, col: str, per_core: int = 1) -> DataFrame:
    """As `spread`, with rows of equal values of a column side by side, for row functions that work on equal values of a batch once; with several partitions a core none waits long for the last."""
    n = max(per_core * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions())
    return df.repartition(n, col).sortWithinPartitions(col)
