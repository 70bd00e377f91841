"""Session helpers.

``build_session`` is for tests, the bench and local runs. Library code never
creates a session: it uses the one it is given and only reads its settings.
"""

from __future__ import annotations

import atexit
import math
import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings a local run needs; on a cluster the deployment supplies its own.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # No broadcast from static (file-size) estimates; AQE broadcasts a join
    # side only when its measured shuffle output is below the threshold.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    # Checkpoint files (range-sliced ranks) are removed once unreferenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(cpus: int = 8, shuffle_partitions: int | None = None,
                  app: str = "tillroll", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = dict(LOCAL_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cpus)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# What a task of a wide write takes in, in stored bytes: sales lines need some twenty
# times their shuffled bytes where they are joined and sorted.
TASK_BYTES = 16 << 20
MOST_PARTITIONS = 1 << 15  # beyond, tasks grow (and their sorts spill) rather than the shuffles' bookkeeping


def sized_session(spark: SparkSession, input_bytes: int) -> SparkSession:
    """A session with the settings of ``spark``, in the same application, whose tasks
    take in about ``TASK_BYTES`` whatever the input's size: shuffles have at least two
    partitions for that many of ``input_bytes``, which AQE joins up to that size, and
    scans are split there. A skewed partition of a join is split from four times that size."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key) or not key.startswith("spark."):
            own.conf.set(key, value)
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    needed = min(math.ceil(2 * input_bytes / TASK_BYTES), MOST_PARTITIONS)
    own.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    own.conf.set("spark.sql.shuffle.partitions", max(configured, needed))
    own.conf.set("spark.sql.files.maxPartitionBytes", TASK_BYTES)
    own.conf.set("spark.sql.files.openCostInBytes", TASK_BYTES // 16)  # small files still share a task
    own.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_BYTES)
    own.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", 4 * TASK_BYTES)
    return own


def _context(spark: SparkSession):
    try:
        return spark.sparkContext
    except Exception:  # Spark Connect sessions have no SparkContext
        return None


def app_id(spark: SparkSession) -> str:
    sc = _context(spark)
    return sc.applicationId if sc is not None else spark.conf.get("spark.app.id", "app")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints and intermediate tables.

    Read from the session (the context's checkpoint dir or
    ``spark.checkpoint.dir``). Where neither is set, a master that runs in one
    process (``local[...]``, as in tests) gets a fresh local folder, registered
    so later calls agree; on a cluster that is an error, because executors on
    other machines could not read such a folder.
    """
    sc = _context(spark)
    if sc is None:
        current = spark.conf.get("spark.checkpoint.dir", None)
    else:
        current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
        if not current and re.fullmatch(r"local(\[.*\])?", sc.master):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="tillroll-ckpt-"))
            current = sc.getCheckpointDir()
    if not current:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return current.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path object for ``path``: what Spark reads, this can list."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Delete ``path`` (a table this application wrote) when the driver ends."""
    fs, target = file_system(spark, path)

    def remove():
        try:
            fs.delete(target, True)
        except Exception:  # the JVM has ended first: the folder's own cleanup remains
            pass
    atexit.register(remove)


def env_cpus(default: int = 8) -> int:
    return int(os.environ.get("BENCH_CPUS", default))
