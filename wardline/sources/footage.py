"""Frames of footage: their clock, and which of them are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def footage_seconds(pts: Column, raw_index: Column, fps: Column) -> Column:
    """Seconds of footage: the presentation time if positive, else by frame rate, else the frame count."""
    return F.when(pts > 0, pts).when(fps > 0, (raw_index - 1) / fps).otherwise((raw_index - 1).cast("double"))


def emitted(frames: DataFrame, stride: int = 1, limit: int | None = None, raw_index: str = "raw_index", key: str = "camera_id") -> DataFrame:
    """Every stride-th frame from the first, at most `limit` of each camera, numbered anew from 1 in `index`."""
    if stride < 1:
        raise ValueError("a stride is at least 1")
    kept = frames.where((F.col(raw_index) - 1) % stride == 0)
    kept = kept.withColumn("index", F.row_number().over(Window.partitionBy(key).orderBy(raw_index)))
    return kept if limit is None else kept.where(F.col("index") <= limit)
