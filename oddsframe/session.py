"""Session settings the jobs are written for."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "oddsframe", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with AQE on and the reporting time zone fixed.

    On a cluster the master, memory and shuffle settings come from spark-submit; the
    arguments only serve local tests.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "Asia/Hong_Kong")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # large column expressions: do not record a Python call site for every node
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def many_tasks(spark: SparkSession) -> int:
    """Tasks for rows that cost far more work than their bytes tell: a small file would else be one task."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for cut lineage and stream state: the cluster's spark.checkpoint.dir.

    Only where a local session names none (tests) a scratch folder is used; executors on other
    machines could not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: for a result that several outputs are made from."""
    path = f"{checkpoint_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
