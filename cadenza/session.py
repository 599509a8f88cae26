"""Session defaults: UTC, ANSI, AQE with skew-join splitting."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(cores: int | str = 8, app: str = "cadenza", **conf: str) -> SparkSession:
    """A local session with the engine's defaults; on a cluster pass the master by spark-submit instead."""
    builder = SparkSession.builder.appName(app)
    if "SPARK_MASTER" not in os.environ and "spark.master" not in conf:
        builder = builder.master(f"local[{cores}]")
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(cores), "spark.driver.memory": "8g"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; a folder of this machine where the master
    is this machine too and none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share (master {spark.sparkContext.master})")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder if re.match(r"[a-z0-9+.-]+:", folder) else f"file://{folder}"


def kept(rows: DataFrame) -> DataFrame:
    """The rows, made once and written to the shared folder as a checkpoint, for whoever reads them more than once."""
    context = rows.sparkSession.sparkContext
    folder = shared_folder(rows.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return rows.checkpoint()
