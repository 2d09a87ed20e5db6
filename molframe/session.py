"""Session defaults and the one way this package cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "molframe", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on. On a cluster the submit command sets the master and the sizes."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return (
        b.config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only in local mode when nothing is set."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if given is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            given = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(given)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the checkpoint folder and go on from the written copy.

    The copy survives lost executors, and its real size is what later joins are planned by: in a loop, estimates
    carried from round to round would multiply instead."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
