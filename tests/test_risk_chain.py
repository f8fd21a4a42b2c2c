"""The shared step from observations to scores and alerts: how often rows are sorted and read, and how long generated methods get."""

import re

import pytest
from oracle import same
from pyspark.sql import functions as F

from wardline.functions import geometry as G
from wardline.operators import alerts
from wardline.plans import operations, readside, tracks

SF = "/root/testdata/sf0.001"


def plan(df, mode="simple"):
    return df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def test_two_sorts(spark):
    """Context, behaviours, score and both alert rules: one sort by track and one by segment, whatever follows."""
    by_track = [x for x in re.findall(r"Sort \[(.*?)\], false", plan(alerts.confirmed(tracks.scored(spark, SF), alerts.DEFAULT, "k"))) if x.startswith("camera_id")]
    assert [("seg" in x, "stay" in x or "off" in x) for x in by_track] in ([(True, False), (False, False)], [(False, False), (True, False)])


@pytest.mark.parametrize("name", ["severity_by_zone", "all_alerts", "metric_speed"])
def test_methods_are_compiled(spark, name):
    """The machine code compiler passes over methods of more than 8,000 bytes; such a step took several times as long."""
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        query = tracks.QUERIES.get(name) or readside.QUERIES[name]
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", plan(query(spark, SF), "codegen"))]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert sizes and max(sizes) < 8000


@pytest.mark.parametrize("name", ["all_alerts", "alert_union"])
def test_rules_share_a_pass(spark, name):
    query = readside.QUERIES.get(name) or operations.QUERIES[name]
    assert len(re.findall(r"exists\(behaviours", plan(query(spark, SF)))) == 1
    same(spark, SF, query, (readside.ORACLE.get(name) or operations.ORACLE[name]))


def test_track_alerts(spark):
    """Both rules in one pass give what each gives alone."""
    s = tracks.scored(spark, "/root/testdata/sf0.01")
    cols = ["camera_id", "track_id", "event_id", "severity", "score"]
    rows = lambda d: sorted(map(tuple, d.select(cols).collect()))
    both = alerts.track_alerts(s)
    for kind, alone in (("fence", alerts.fence_alerts(s)), ("tamper", alerts.tamper_alerts(s))):
        assert rows(both.where(F.col("kind") == kind)) == rows(alone) != []


def test_points_on_edges_and_missing(spark):
    """Upright and level edges have shorter terms; odd points fall as they did."""
    square = ((0.2, 0.2), (0.6, 0.2), (0.6, 0.8), (0.2, 0.8))
    points = [(0.2, 0.5, True), (0.6, 0.8, True), (0.6, 0.81, False), (0.4, 0.2, True), (0.4, 0.5, True), (float("nan"), 0.5, False), (float("inf"), 0.5, False), (0.4, float("-inf"), False), (0.1, 0.2, False), (None, 0.5, False)]
    d = spark.createDataFrame(points, "x double, y double, want boolean").withColumns({"_x": G.solid(F.col("x")), "_y": G.solid(F.col("y"))})
    assert all(r.got == r.want for r in d.select("want", G.inside(F.col("_x"), F.col("_y"), square).alias("got")).collect())
