"""Session settings and durable intermediate results."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: SQL settings every job wants; all of them can be changed on a running session.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # top-k filters on row_number() are cut on the map side up to this k
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for name, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def local_session(cores: int = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("panelwake")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def _checkpoint_dir(spark: SparkSession) -> str | None:
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get() if current.isDefined() else None


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; on one machine a scratch folder that goes at its end."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if _checkpoint_dir(spark) is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        scratch = tempfile.mkdtemp(prefix="panelwake-")
        atexit.register(shutil.rmtree, scratch, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(scratch)
    return _checkpoint_dir(spark)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage on storage that outlives any single executor."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if _checkpoint_dir(spark) is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
