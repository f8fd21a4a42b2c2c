"""What a task sorts: how many observations, and how wide they are."""

import re

from pyspark.sql import functions as F

from wardline.model import Zone
from wardline.operators import context as C
from wardline.operators.zone_index import ZoneIndex, zone_table
from wardline.plans import fixtures, tracks

SF = "/root/testdata/sf0.001"


def plan(df):
    return df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def test_more_rows_more_tasks(spark, monkeypatch):
    """Observations are dealt into parts by their number; that is the one shuffle of the windows, and results stay."""
    few = tracks.risk_score(spark, SF)
    want = sorted(map(tuple, few.collect()))
    monkeypatch.setattr(fixtures.by_track, "__defaults__", (100,))
    many = tracks.risk_score(spark, SF)
    parts = -(-spark.read.parquet(f"{SF}/events.parquet").count() // 100)
    assert re.findall(r"hashpartitioning\(user_id#\d+L, (\d+)\), (\w+)", plan(many)) == [(str(parts), "REPARTITION_BY_NUM")]
    assert len(re.findall("Exchange", plan(many))) == 1 and many.rdd.getNumPartitions() == parts > 4
    assert sorted(map(tuple, many.collect())) == want


def test_edges_stay_out_of_the_sorts(spark):
    """Zones of a camera and zones for all, of one ordinal and name: the oldest point is held against the edges of the right one."""
    square = lambda x, y, w: ((x, y), (x + w, y), (x + w, y + w), (x, y + w))
    zones = [Zone("A", "RESTRICTED", 60, square(0.7, 0.6, 0.2)), Zone("B", "RESTRICTED", 50, square(0.10371, 0.6, 0.2), camera_id="CAM-01"), Zone("A", "RESTRICTED", 40, square(0.4, 0.1, 0.1), camera_id="CAM-02")]
    o = tracks.observations(spark, "/root/testdata/sf0.01")
    for table in (zone_table(spark, zones), zone_table(spark, zones).withColumn("ordinal", F.lit(0))):
        got = C.context(o, ZoneIndex.build(table, 8))
        cols = ["event_id", F.round("target_d", 9).alias("d"), "target", "approaching", "streak"]
        assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, C.context(o, zones).select(cols).collect()))
        sorts = [x for x in re.split(r"\n", plan(got)) if "Window" in x]
        assert sorts and not any("edges" in x for x in sorts)
        assert "edges" not in [f.name for f in ZoneIndex.build(table, 8).place(o).schema["nearest"].dataType]
