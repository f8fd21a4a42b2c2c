"""Rows that repeat, rows without ids, and keys that many rows share."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from wardline.llm import embedding_dedup, jaccard_join, quality, sharding


def test_vectors_that_repeat_an_id(spark):
    """Each row is a vector of its own, whatever ids others have."""
    x = np.eye(16)
    near = lambda a, b: (0.97 * a + 0.243 * b).tolist()
    rows = [(1, x[0].tolist(), 0), (1, x[1].tolist(), 0), (2, near(x[0], x[2]), 0), (3, near(x[1], x[3]), 0), (1, x[0].tolist(), 1), (5, x[0].tolist(), 1), (5, x[0].tolist(), 1), (9, x[7].tolist(), 0)]
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == Counter([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (1, 2, 1, True), (5, 2, 1, False), (5, 2, 1, False), (9, 0, 9, True)])


def test_component_of_the_smallest_id(spark):
    """The smallest id of a chain of vectors, whose kinds come in any order."""
    ids, x, at = [70, 12, 55, 31, 90, 8, 44, 61, 23, 17, 39, 80], np.eye(16), np.eye(16)[15]
    chain = [at := 0.96 * at + 0.28 * x[k] for k in range(12)]
    df = spark.createDataFrame([(i, v.tolist(), 3) for i, v in zip(ids, chain)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.link(df).collect()}
    assert got == {i: (2 if 0 < k < 11 else 1, 8) for k, i in enumerate(ids)}


def test_copies_are_shuffled_like_other_rows(spark):
    """800 copies among 8,800 rows: they lie apart in each shard, and shards stay exact."""
    d = spark.createDataFrame([(i, f"t{i}") for i in range(8000)] + [(None, "copy")] * 800, "doc_id long, text string")
    for limit in (sharding.SENT, 0):
        sharding_sent, sharding.SENT = sharding.SENT, limit
        try:
            got = sharding.shard(d, 8, rows_per_task=500).toPandas()
        finally:
            sharding.SENT = sharding_sent
        assert len(got) == 8800 and got.groupby("shard").slot.agg(["count", "max", "nunique"]).eq([1100, 1099, 1100]).all().all()
        for _, mine in got[got.text == "copy"].groupby("shard"):
            at = np.sort(mine.slot)
            assert 60 < len(at) < 150 and np.diff(at).max() > 20 and (np.diff(at) == 1).mean() < 0.3  # not in one stretch
    again = sharding.shard(d.repartition(5), 8, rows_per_task=500).toPandas()
    key = lambda df: sorted(map(tuple, df.fillna(-1).values.tolist()))
    assert key(got) == key(again)


def test_quality_without_ids(spark):
    """The scorer is fitted on texts, whether or not their rows have ids or repeat them."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for odd in (d.withColumn("doc_id", F.lit(None).cast("long")), d.withColumn("doc_id", F.lit(4).cast("long")), d.union(d)):
        _, scorer = quality.fit(odd)
        assert (scorer.weights != 0).sum() > 500
        assert (quality.fit(odd.repartition(3))[1].weights == scorer.weights).all()
    many = spark.createDataFrame([(None, "same text of many rows")] * 3000 + [(i, f"other words {i}") for i in range(50)], "doc_id long, text string")
    assert quality.fit(many, sample=40)[1].bits == 16


def test_votes_are_a_text_s_own():
    texts = [b"One. Two! Three?", b" starts with a space", b"no end", b"", None, b".", b"x.\ny", b"ends."]
    assert (quality.votes(texts) == np.concatenate([quality.votes([t]) for t in texts])).all()
    assert quality.features(texts)["sentence_ends"][[0, 1, 2, 5, 6, 7]].tolist() == [1, 0, 0, 1, 0.5, 1]


def test_fit_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(quality, "BYTES", 5000)
    seen = []
    monkeypatch.setattr(quality.Scorer, "fit", classmethod(lambda cls, texts, target: seen.extend(texts)))
    d = spark.createDataFrame([(i, random.Random(i).choice("abcde") * 900) for i in range(100)], "doc_id long, text string")
    quality.fit(d)
    assert 0 < sum(map(len, seen)) <= 5000


def largest_share(df):
    n = [r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect()]
    return max(n) / sum(n)


def test_rows_without_a_key_stay_spread(spark):
    """Texts without words and vectors without a label are not dealt to one task."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        docs = spark.range(0, 4000, numPartitions=4).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("some words of text number "), F.col("id"))).alias("text"))
        assert largest_share(jaccard_join.jaccard_join(docs)) < 0.4
        vecs = spark.range(0, 4000, numPartitions=4).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id"), F.lit(0.5), F.sin(F.col("id") * 3)).alias("embedding"), F.when(F.col("id") % 40 == 0, 1).alias("label"))
        assert largest_share(embedding_dedup.link(vecs)) < 0.4
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
