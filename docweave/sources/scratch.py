"""A folder that the driver and all executors share, for what a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="docweave-")
    return folder


def scratch(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; only a local session may lack the setting, and gets a temporary folder."""
    return f"{_folder(spark)}/scratch-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows written once by checkpoint(), so that what reads them twice does not make them twice."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(_folder(df.sparkSession))
    return df.checkpoint()
