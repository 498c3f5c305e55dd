"""Session settings and the shared folder for tables that outlive one plan."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Whole texts travel to Python; a batch of the default ten thousand is tens of MB on each side.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    # Rows picked for their long texts would otherwise fill batches of 64 MB.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8388608b",
}


#: Folders made for local applications that name none; the setting itself is fixed at their start.
_LOCAL_FOLDERS: dict[str, str] = {}


def local_session(cores: int | str = "*", app: str = "chorus") -> SparkSession:
    """A local session for tests and measurements."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "12g")
               .config("spark.sql.shuffle.partitions", "8")
               # Capturing the call site of every column costs several JVM calls each.
               .config("spark.python.sql.dataFrameDebugging.enabled", "false"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return apply_settings(spark)


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL settings every job of the library relies on.

    Python workers import the library from the place the driver has it, where it is
    not installed for them.
    """
    root, known = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([root, *paths])
    for key, value in SESSION_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``.

    A machine-local folder is only used on a local master with no setting.
    """
    root, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if context.applicationId not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="chorus-")
        root = _LOCAL_FOLDERS[context.applicationId]
    return f"{root.rstrip('/')}/chorus/{purpose}-{uuid.uuid4().hex}"


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Lineage is cut in a way that survives the loss of executors, and the file
    size gives Catalyst a real statistic: a staged lookup is broadcast when it
    is below ``spark.sql.autoBroadcastJoinThreshold`` and shuffled otherwise, so
    no operator has to hint a broadcast it cannot bound.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete a staged table that only its maker knows and nothing will read again."""
    spark = df.sparkSession
    java, configuration = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {os.path.dirname(file) for file in df.inputFiles()}:
        path = java.org.apache.hadoop.fs.Path(java.java.net.URI.create(folder))
        path.getFileSystem(configuration).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more.

    Its cleaner does so when the driver's JVM collects garbage, which a driver with little to do
    puts off while executors' disks fill. Frames of Python refer to plans until they are collected
    too, and events of the last job do for a moment.
    """
    gc.collect()
    for wait in (0, 1):
        time.sleep(wait)
        spark.sparkContext._jvm.System.gc()
