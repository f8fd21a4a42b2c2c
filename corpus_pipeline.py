"""The corpus pipeline: documents through five stages, each over all that the one before has kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import bpe, decontamination, jaccard_join, language_id, substring_dedup
from wardline.llm.common import bounded, cut, held_out, named, read, ready


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter; null texts and those without one go. What the rows with a language teach rejects no other document,
    so none is lost where they teach no language, or one that is named und."""
    filters = language_id.fit(docs.where(~held_out(F.col("doc_id"))).select("lang", "text"))
    bare = "_bare"
    while bare in docs.columns:
        bare += "_"
    return language_id.predict(docs, filters, rejected=bare).where(~F.col(bare)).select(*docs.columns)


def join_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the smallest id, nulls last. Rows that repeat its id and text go, too."""
    found = cut(jaccard_join.classes(docs.select("doc_id", "text")))
    name = named(F.col("doc_id"), F.col("text"))
    gone = found.where(~F.col("stays")).select(F.col("d1").alias("_d1"), F.col("d2").alias("_d2")).distinct()
    gone = bounded(gone, jaccard_join.SENT)
    left = docs.join(gone, (name[0] == F.col("_d1")) & (name[1] == F.col("_d2")), "left_anti")
    again = cut(found.where("stays").groupBy(F.col("d1").alias("_d1"), F.col("d2").alias("_d2")).count().where("count > 1").drop("count"))
    if again.isEmpty():
        return left.select(*docs.columns)
    again = bounded(again, jaccard_join.SENT)
    same = (name[0] == F.col("_d1")) & (name[1] == F.col("_d2"))
    return left.join(again, same, "left_anti").union(left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones have; text and n_chars change where words went, and a document of which
    no word is left goes."""
    aside = {c: f"_own{i}_{'_'.join(docs.columns)}" for i, c in enumerate(docs.columns) if c in substring_dedup.OWN}  # names that the operator gives
    got = substring_dedup.remove_repeats(docs.withColumnsRenamed(aside))
    changed = F.col("n_removed") > 0
    out = {"text": F.when(changed, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(changed, F.char_length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return got.where("n_removed < n_words or n_removed = 0").withColumns(out).select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, as counts and digests, and the digest of what they decode to."""
    return bpe.digests(docs)


STAGES = [("language_id", identify), ("jaccard_join", join_near), ("substring_dedup", cut_repeats), ("decontaminate", drop_leaks), ("byte_bpe", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet in the shared checkpoint folder and read again."""
    ready(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express language identification; tests hold run() against a brute-force version.
ORACLE_SQL = None
