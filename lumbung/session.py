"""Session helpers: a tuned local session and the shared folder of a cluster."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "lumbung", memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .getOrCreate()
    )


def is_local(spark: SparkSession) -> bool:
    """Whether tasks run in the driver's own process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only on one machine (a ``local`` master), where the setting is absent, a local folder is made, set,
    and deleted at the end; on a cluster without the setting this raises RuntimeError.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None and not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if named is None:
            folder = tempfile.mkdtemp(prefix="lumbung-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            sc.setCheckpointDir(folder)
        else:
            sc.setCheckpointDir(named)
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that loops don't grow the plan.

    The files go when the session's cleaner finds the plan unused (``local_session`` sets that up; a
    cluster does by ``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, p = hadoop_path(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


class Scratch:
    """Parquet tables in the shared folder for the length of a ``with`` block."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> "Scratch":
        return self

    def table(self, name: str, df: DataFrame) -> DataFrame:
        """Write ``df`` and return a reader of what was written."""
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def __exit__(self, *_) -> None:
        delete_path(self.spark, self.path)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the JVM for ``path``, on any storage Hadoop knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_partitions(df: DataFrame) -> int:
    """About how many tasks read ``df``, by the size that its plan tells; nothing is run."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # the plan doesn't know
        return spark.sparkContext.defaultParallelism
    return max(1, -(-size // spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))))


def rows_written(spark: SparkSession, write: Callable[[], None]) -> int:
    """Run a write and return the rows that its tasks say they wrote; no second run of the plan."""
    sc = spark.sparkContext
    before, group = sc.getLocalProperty("spark.jobGroup.id"), f"write-{uuid.uuid4().hex}"
    sc.setLocalProperty("spark.jobGroup.id", group)
    try:
        write()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", before)
    inner = sc._jsc.sc()
    inner.listenerBus().waitUntilEmpty(60_000)
    tracker, n = sc.statusTracker(), 0
    for job in tracker.getJobIdsForGroup(group):
        for stage in tracker.getJobInfo(job).stageIds:
            try:
                n += inner.statusStore().lastStageAttempt(stage).outputRecords()
            except Py4JJavaError:  # a stage that was skipped
                continue
    return n


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for the functions that run there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lumbung-"), "lumbung_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("lumbung", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
