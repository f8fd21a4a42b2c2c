"""How good the reads and the detector are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import plates as P
from wardline.operators import plates as V


def read_accuracy(reads: DataFrame, by: list[str], truth: str = "truth", guess: str = "guess", valid: str = "valid") -> DataFrame:
    """Per group: reads, exact, mean character overlap, validated, validated but wrong, empty."""
    t, g = F.col(truth), F.coalesce(F.col(guess), F.lit(""))
    return reads.groupBy(*by).agg(
        F.count("*").alias("reads"), F.sum((t == g).cast("int")).alias("exact"), F.round(F.avg(P.overlap(t, g)), 6).alias("characters"),
        F.sum(F.col(valid).cast("int")).alias("validated"), F.sum((F.col(valid) & (t != g)).cast("int")).alias("validated_wrong"), F.sum((g == "").cast("int")).alias("empty"),
    )


def consensus_metrics(reads: DataFrame, key: list[str], truth: str, guess: str, order: str, most: int = 5) -> DataFrame:
    """Groups of two reads or more, of each the first `most`: reported, right, wrong, silent, precision, recall."""
    w = Window.partitionBy(*key).orderBy(order)
    first = reads.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    agreed = V.consensus(first, key, guess, order, 2)
    groups = first.groupBy(*key).agg(F.count("*").alias("n"), F.min(truth).alias("truth")).where("n >= 2").join(agreed, key)
    right = (F.col("consensus") == F.col("truth")).cast("int")
    out = groups.agg(F.count("*").alias("groups"), F.count("consensus").alias("reported"), F.coalesce(F.sum(right), F.lit(0)).alias("right"))
    return out.withColumns({"wrong": F.col("reported") - F.col("right"), "silent": F.col("groups") - F.col("reported"), "precision": F.round(F.col("right") / F.col("reported"), 6), "recall": F.round(F.col("right") / F.col("groups"), 6)})


def confusions(reads: DataFrame, truth: str = "truth", guess: str = "guess") -> DataFrame:
    """Counts of characters read as others, over reads of the right length."""
    pairs = F.explode(F.arrays_zip(F.split(truth, "").alias("t"), F.split(guess, "").alias("g")))
    p = reads.where(F.length(truth) == F.length(guess)).select(pairs.alias("p"))
    return p.select(F.col("p.t").alias("was"), F.col("p.g").alias("read_as")).where("was <> read_as").groupBy("was", "read_as").agg(F.count("*").alias("n"))


def hit_rate(rows: DataFrame, conditions: list[str], size: str = "size", condition: str = "condition", hit: str = "hit") -> DataFrame:
    """Share of hits by size, a column for each condition."""
    return rows.groupBy(size).pivot(condition, conditions).agg(F.round(F.avg(F.col(hit).cast("double")), 6))


def smallest_size(rows: DataFrame, share: float = 0.99, size: str = "size", condition: str = "condition", hit: str = "hit") -> DataFrame:
    """By condition, the smallest size of which at least `share` are hit; null if there is none."""
    rate = rows.groupBy(condition, size).agg(F.avg(F.col(hit).cast("double")).alias("rate"))
    return rate.groupBy(condition).agg(F.min(F.when(F.col("rate") >= share, F.col(size))).alias("smallest"))


def split(rows: DataFrame, plate: str, share: float) -> DataFrame:
    """rows with split: validation for a stable share of plates, else train; a plate is never in both."""
    return rows.withColumn("split", F.when(P.holdout(F.col(plate), share), "validation").otherwise("train"))


def leakage(rows: DataFrame, plate: str) -> DataFrame:
    """Plates that are in both splits."""
    part = lambda s: rows.where(F.col("split") == s).select(plate)
    return part("train").intersect(part("validation"))


def split_outcomes(rows: DataFrame, plate: str, share: float, width: str, min_width: int, unreadable: Column | None = None, area: str | None = None) -> DataFrame:
    """Rows (outcome, crops, plates): what becomes of annotated plates, by split or by the first reason to skip them: the photograph is
    unreadable, the box too small, or nothing of it lies within the photograph (area, in pixels). Skipped ones count no plates."""
    reasons = [(unreadable, "unreadable photograph"), (F.col(width) < min_width, "too small"), (F.col(area) <= 0 if area else None, "empty crop")]
    skipped = F.coalesce(*[F.when(c, name) for c, name in reasons if c is not None])
    got = split(rows, plate, share).withColumn("outcome", F.coalesce(skipped, "split"))
    return got.groupBy("outcome").agg(F.count("*").alias("crops"), F.countDistinct(F.when(F.col("outcome") == F.col("split"), F.col(plate))).alias("plates"))
