"""Rows reach Python a few megabytes at a time."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardline.llm import bpe, jaccard_join, language_id
from wardline.llm.common import HANDED

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unset(spark):
    was = spark.conf.get(KEY, None)
    spark.conf.unset(KEY)
    yield
    spark.conf.unset(KEY) if was is None else spark.conf.set(KEY, was)


def documents(spark):
    """12 MB in one partition, in two languages."""
    text = F.concat(F.lit("doc "), F.col("id").cast("string"), F.repeat(F.when(F.col("id") % 2 == 0, " the house").otherwise(" une maison"), 400))
    return spark.range(3000).coalesce(1).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "en").otherwise("fr").alias("lang"), text.alias("text"))


@pytest.mark.parametrize("use", [
    lambda d: language_id.predict(d, language_id.fit(d.select("lang", "text").limit(10))), lambda d: bpe.digests(d),
    lambda d: jaccard_join.signatures(d, "doc_id", "text", 5, 0.8),
])
def test_batches_are_small(spark, unset, use):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["size", "n"])

    d = documents(spark)
    use(d)
    got = d.mapInArrow(sizes, "size bigint, n bigint").collect()
    assert sum(r.n for r in got) == 3000 and max(r.size for r in got) < 1.1 * HANDED


def test_own_setting_stays(spark, unset):
    spark.conf.set(KEY, "9m")
    bpe.digests(documents(spark))
    assert spark.conf.get(KEY) == "9m"


def test_rows_over_several_batches(spark, unset):
    """Every row once, with its own language."""
    d = documents(spark)
    got = language_id.predict(d, language_id.fit(d.select("lang", "text"))).select("doc_id", "lang", "lang_pred").collect()
    assert sorted(r.doc_id for r in got) == list(range(3000)) and all(r.lang == r.lang_pred for r in got)
