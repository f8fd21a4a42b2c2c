"""What several operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators.lineage import cut, ready  # noqa: F401

#: ASCII space characters; words of most operators are the runs between them.
SPACES = r"[ \t-\r]+"
#: Bytes of rows that a Python worker is handed at once.
HANDED = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, which may not have it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_wardline_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="spark-wardline-")
    target = os.path.join(folder, "wardline_pkg.zip")
    with zipfile.ZipFile(target, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent).as_posix())
    sc.addPyFile(target)
    sc._wardline_shipped = True


def by_few(spark: SparkSession) -> None:
    """Have the session hand rows to Python some megabytes at a time, where nothing else is set. A batch is held several times over, in
    buffers of the executor outside its heap and in the worker, for each task; Spark's own limits are 10,000 rows and 64 MB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(HANDED))


def kept(df: DataFrame) -> DataFrame:
    """df written as a table into the shared checkpoint folder and read again, so that it is computed once. The folder is the cluster's
    to clear, as the checkpoints in it are: results that are not yet written may still be read from it."""
    ready(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it holds at most so many rows. It is counted first; give it only what is cut or cheap to count."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def settle() -> None:
    """At the end of a task: give memory that Python no longer uses back to the system, which a reused worker would keep."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model may learn labels from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def as_long(bits: Column) -> Column:
    return bits.cast("long")


def with_least(rows: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """rows (a, b) with m of low (a, m, n), n being the number of rows of a among total. What more than a thousandth of the rows share
    is sent to all tasks (so 1,000 keys at most); only the rest is dealt out by a."""
    many = F.col("n") > total // 1000
    sent = F.broadcast(low.where(many).select("a", F.col("m").alias("_m")))
    rows = rows.join(sent, "a", "left")
    rest = rows.where("_m is null").select("a", "b").join(low.where(~many).select("a", "m"), "a")
    return rows.where("_m is not null").select("a", "b", F.col("_m").alias("m")).union(rest)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), component being the smallest node reachable.

    Alternates large-star and small-star steps: the neighbours of each node are linked to the smallest of them, until nothing
    changes. Minima are taken by partial aggregation and joined back, those of hubs by broadcast, so that a node of many neighbours
    is never gathered. Each round is cut into the shared folder. Nodes without edges have no row; self-edges and repeats are allowed.
    """

    def size(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    state = size(e)
    while state[0]:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = with_least(both.where("b > a"), low, 2 * state[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = with_least(large, low, state[0]).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = cut(small.where("a > b").distinct())
        seen, state = state, size(e)
        if state == seen:
            break
    low = e.groupBy("a").agg(F.min("b").alias("component"))
    roots = low.select(F.col("component").alias("node")).distinct().withColumn("component", F.col("node"))
    return low.withColumnRenamed("a", "node").union(roots)


def named(doc: Column, text: Column) -> tuple[Column, Column]:
    """Two numbers that stand for an id and its text, nulls included."""
    return F.xxhash64(doc, text).alias("d1"), F.xxhash64(F.lit(1), text, doc).alias("d2")


def join_sized(rows: DataFrame, sizes: DataFrame, key: str, total: int) -> DataFrame:
    """rows with n of sizes (key, n): how many rows a key has, or their weight, out of total. Keys of more than a thousandth of it
    (so 1,000 at most) are sent to all tasks; only the rows of the others are dealt out by key."""
    many = F.col("n") > total // 1000
    rows = rows.join(F.broadcast(sizes.where(many).withColumnRenamed("n", "_n")), key, "left")
    rest = rows.where("_n is null").drop("_n").join(sizes.where(~many), key)
    return rows.where("_n is not null").withColumnRenamed("_n", "n").unionByName(rest)


def block_pairs(members: DataFrame, member: str, limit: int) -> DataFrame:
    """members with own, b1, b2: each group, of size n, cut into blocks of about limit, and a row for each pair of blocks.

    Grouping by the group, b1 and b2 then brings every two members of a group together exactly once (members of one block where
    b1 = b2), without any task holding a large group. A group of n members gives n * n / limit rows, n if it fits.
    """
    nb = F.ceil(F.col("n") / limit).cast("int")
    out = members.withColumn("nb", nb).drop("n").withColumn("own", F.pmod(F.xxhash64(F.lit(5), member), F.col("nb")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return out.withColumns({"b1": F.least("own", "other"), "b2": F.greatest("own", "other")}).drop("nb", "other")
