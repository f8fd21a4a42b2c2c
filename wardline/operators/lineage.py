"""Cutting a plan's lineage in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ready(spark: SparkSession) -> None:
    """Have a checkpoint folder: the cluster's shared one. In local mode, as in tests, a temporary one will do."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local($|\[)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, in the shared checkpoint folder."""
    ready(df.sparkSession)
    return df.checkpoint()
