"""Spark session and lineage helpers."""

from __future__ import annotations

import os
import posixpath
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "cohortspark") -> SparkSession:
    """Create (or reuse) a session with AQE on and the UI off.

    On a cluster, pass ``master=None`` so the launcher's settings win; the
    shuffle-partition count then comes from the cluster config as well.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # broadcast only what the planner can prove small
        "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    }
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", os.environ.get("COHORT_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared, fault-tolerant folder there; we only invent a
    local one when nothing is configured (tests on local mode).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf_dir = tempfile.mkdtemp(prefix="cohortspark-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def stored(df: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the lineage ends at files that
    survive lost executors, and the planner knows their size. ``row_group`` is the size of a row group in bytes."""
    path = posixpath.join(checkpoint_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    writer = df.write.option("parquet.block.size", row_group) if row_group else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_rows(df: DataFrame, name: str) -> DataFrame:
    """``stored`` for rows that many fits read: in row groups of about 1 MB. A task reads whole row groups, so files of one
    large group each leave most tasks of a scan without rows."""
    return stored(df, name, row_group=1 << 20)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss) for iterative loops."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
