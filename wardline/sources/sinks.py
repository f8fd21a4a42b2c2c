"""Where results go: day files, the upserted store, datasets and reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators.store import upsert


def day_json(df: DataFrame, path: str, at: str, mode: str = "append") -> None:
    """One JSON object for each row, in a folder for each day of the event. Nulls are written."""
    df.withColumn("day", F.date_format(at, "yyyyMMdd")).write.mode(mode).partitionBy("day").option("ignoreNullFields", False).json(path)


def split_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").json(path)


def report(df: DataFrame, path: str) -> None:
    """Metrics of a run; a few rows."""
    df.coalesce(1).write.mode("overwrite").json(path)


def store(new: DataFrame, path: str, key: str = "event_id", version: str = "seq", day: str = "event_date", cluster: tuple[str, ...] = ("camera_id",), bloom: tuple[str, ...] = ("event_id", "plate")) -> None:
    """Write new rows into a Parquet store partitioned by day, in place of rows of the same key (`store.upsert`). Only the days of new rows
    are rewritten, and a column new to the store is null on older rows. An event keeps its day. One writer at a time.

    A day's rows are dealt into files by ranges of the cluster columns and sorted by them, and files carry Bloom filters of the bloom
    columns, so that a search reads few of them; rewriting a day also puts its small files together. New days are written
    beside the store first and moved from there. What a write that broke off has left there is moved at the next one if it
    was complete, and dropped if not."""
    spark = new.sparkSession
    recover(spark, path, day)
    old = None
    if _fs(spark, path).exists(_path(spark, path)):
        days = [r[0] for r in new.select(day).distinct().collect()]  # days of one write
        old = spark.read.option("mergeSchema", True).parquet(path).where(F.col(day).isin(*days))
        old = old.withColumn(day, F.col(day).cast(new.schema[day].dataType))
    got = upsert(old, new, key, version)
    order = [day, *[c for c in cluster if c in got.columns]]
    beside = f"{path.rstrip('/')}-new-{uuid.uuid4().hex}"
    write = got.repartitionByRange(*order).sortWithinPartitions(*order).write
    for c in bloom:
        if c in got.columns:
            write = write.option(f"parquet.bloom.filter.enabled#{c}", "true")
    write.partitionBy(day).parquet(beside)
    recover(spark, path, day)


def recover(spark: SparkSession, path: str, day: str = "event_date") -> None:
    """Move the days that lie complete beside a store into it. Doing so again, after breaking off, gives the same."""
    fs, here = _fs(spark, path), _path(spark, path.rstrip("/"))
    for f in fs.globStatus(_path(spark, f"{path.rstrip('/')}-new-*")) or ():
        beside = f.getPath()
        if fs.exists(_path(spark, f"{beside}/_SUCCESS")):
            fs.mkdirs(here)
            for d in fs.listStatus(beside):
                name = d.getPath().getName()
                if name.startswith(f"{day}="):
                    fs.delete(_path(spark, f"{here}/{name}"), True)
                    if not fs.rename(d.getPath(), _path(spark, f"{here}/{name}")):
                        raise OSError(f"{d.getPath()} could not be moved")
        fs.delete(beside, True)


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def epoch_json(batch: DataFrame, epoch: int, path: str, at: str) -> None:
    """`day_json` for streams: each batch in a folder of its own, which a repeated epoch writes over, so that its rows count once."""
    day_json(batch, f"{path}/epoch={epoch}", at, "overwrite")


def committed(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows that `epoch_json` has written; an epoch that broke off is not there yet."""
    fs = _fs(spark, path)
    done = [str(f.getPath()) for f in fs.globStatus(_path(spark, f"{path}/epoch=*")) or () if fs.exists(_path(spark, f"{f.getPath()}/_SUCCESS"))]
    return spark.read.schema(schema).option("basePath", path).json(done) if done else spark.createDataFrame([], schema)


def fan_out(*sinks: Callable[[DataFrame, int], None], manifest: str | None = None) -> Callable[[DataFrame, int], list[Exception]]:
    """A foreachBatch function that gives each batch to every sink; a sink that fails does not stop the others, and its error is
    logged and returned.

    With a manifest, a shared folder, what each sink has done with an epoch is recorded, and the function raises once all have had
    their turn and one has failed: the stream then repeats the epoch when it starts again, and only the sinks that have not
    done it get it. A sink that breaks off after its own commit and before the record is called twice for an epoch, so it
    must write over what it wrote for it, as `epoch_json` and `store` do."""
    import logging

    def write(batch: DataFrame, epoch: int) -> list[Exception]:
        batch.persist()
        failed, spark = [], batch.sparkSession
        for n, s in enumerate(sinks):
            mark = f"{manifest}/epoch={epoch}/sink={n}"
            if manifest and _fs(spark, mark).exists(_path(spark, mark)):
                continue
            try:
                s(batch, epoch)
                if manifest:
                    _fs(spark, mark).create(_path(spark, mark)).close()
            except Exception as e:  # the others still get the batch
                logging.getLogger(__name__).exception("sink %s failed on batch %s", s, epoch)
                failed.append(e)
        batch.unpersist()
        if manifest and failed:
            raise failed[0]
        return failed

    return write
