"""Session defaults and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "pairloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are tuned for; a running one is reused.

    Shuffle width is left to the cluster's own default plus AQE coalescing: size
    ``spark.sql.shuffle.partitions`` high on a cluster (AQE merges small ones),
    and to the core count on a laptop.
    """
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.scheduler.mode": "FAIR",
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a session of one JVM without ``spark.checkpoint.dir`` (a local test) gets a
    temporary folder, and that one is then remembered in the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="pairloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_MARKED: set[str] = set()


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses; it is removed when the application ends."""
    root = f"{shared_folder(spark)}/pairloom/{spark.sparkContext.applicationId}"
    if root not in _MARKED:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _MARKED.add(root)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read again: used twice, it is computed once and survives lost executors."""
    path = fresh_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
