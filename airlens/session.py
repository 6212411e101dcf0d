"""Session settings the engine relies on."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# SQL settings set on any session the engine is given. The first two change results. The
# third leaves methods the JVM would not compile (over 8000 bytes of code) out of whole-stage
# code; the wide window aggregate runs about a third faster that way.
REQUIRED_SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# Settings that only change speed; used when the engine makes its own session.
TUNING_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Window, aggregate and join over (capture, cell) share one exchange.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Building a plan of hundreds of columns is faster without a stack trace for each.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int = 8, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("airlens")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
    )
    for key, value in {**REQUIRED_SQL_CONF, **TUNING_CONF}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Make a session made elsewhere ready: settings results depend on, and the package itself."""
    for key, value in REQUIRED_SQL_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    _ship_package(spark)
    return spark


def _ship_package(spark: SparkSession) -> None:
    """Send the package to the executors once; their Python workers import it in pandas functions."""
    context = spark.sparkContext
    if getattr(context, "_airlens_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="airlens-code-"), "airlens_package")
    context.addPyFile(shutil.make_archive(archive, "zip", root, "airlens"))
    context._airlens_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the cluster's checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session. Only where it is unset, as in
    local tests, a temporary folder is made.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    path = getattr(spark, "_airlens_shared_dir", None)
    if path is None:
        path = tempfile.mkdtemp(prefix="airlens-")
        spark._airlens_shared_dir = path
    return path


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    path = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(os.path.join(path, "rdd"))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data, in whatever store it lies."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
