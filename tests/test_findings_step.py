"""Findings in the score: what is read again, moved again and interpreted on the way, and that the results stay."""

import re

import pytest
from pyspark.sql import functions as F

from wardline.operators import plates, risk
from wardline.plans import operations, tracks

SF = "/root/testdata/sf0.001"


@pytest.fixture
def large(spark):
    """Plans as for large tables: nothing is small enough to broadcast, and nothing is decided while it runs."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def plan(df, mode="formatted"):
    return df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


@pytest.mark.parametrize("name", ["risk_with_findings", "finding_effect"])
def test_scored_rows_stay(large, name):
    """Rows with their behaviours are not shuffled or sorted again to meet the findings."""
    nodes = plan(operations.QUERIES[name](large, SF)).split("\n\n")
    moved = [n for n in nodes if re.match(r"\s*\(\d+\) (Exchange|Sort)\b", n)]
    assert moved and not [n for n in moved if "behaviours" in n or "stream_ms" in n and "streak" in n]


def test_texts_are_normalised_once(large):
    """No read is normalised to find out whether it has a plate: the plates of distinct texts are."""
    nodes = plan(operations.registry_once(large, SF)).split("\n\n")
    tests = [n for n in nodes if re.match(r"\s*\(\d+\) (Filter|SortMergeJoin|ShuffledHashJoin)\b", n)]
    assert tests and not [n for n in tests if "regexp_extract" in n]


def test_factors_are_compiled(spark):
    """Arrays of factors are concatenated in generated code; a filter of them is interpreted."""
    df = tracks.scored(spark, SF).select("factors", "behaviours")
    assert not re.search(r"filter\(array\(", plan(df, "extended").partition("== Optimized Logical Plan ==")[2])


def test_first_texts(spark):
    """The plates that tracks are checked by are those of all accepted reads; texts of no plate, unsure reads and ties included."""
    texts = ["DL05AB1234", "dl 05 ab 1234", "TAXI", None, "", "DLO5AB1234", "MH12CD0001", "21BH1234AA", "ZZ99ZZ9999"]
    rows = [("C1" if t % 3 else "C2", t % 11, t // 11 % 5, texts[t * 7 % 9] if t % 11 else "TAXI", "CAR" if t % 2 else "BUS", (t * 37 % 100) / 100, t * 13 % 120, t) for t in range(400)]
    reads = spark.createDataFrame(rows, "camera_id string, track_id long, k long, raw string, label string, confidence double, sharpness long, event_id long")
    reads = reads.where("label = 'CAR'")
    fleet = spark.createDataFrame([("C1", 1, 0, "KA01AA0001", "CAR"), ("C9", 99, 3, None, "CAR"), ("C9", 98, 3, "KA01AA0002", "CAR")], "camera_id string, track_id long, k long, plate string, label string")
    all_ = plates.accept(reads).select("camera_id", "track_id", "k", "plate", "label")
    want = {tuple(r) for r in plates.first_plates(all_, fleet).collect()}
    got = [tuple(r) for r in plates.first_plates(plates.first_texts(reads), fleet).collect()]
    assert set(got) == want and len(got) == len(want) > 10
    first = {}  # by hand
    for r in sorted([(r.k, False, r.plate, r.camera_id, r.track_id, r.label) for r in all_.collect()] + [(0, True, "KA01AA0001", "C1", 1, "CAR"), (3, True, "KA01AA0002", "C9", 98, "CAR")]):
        first.setdefault(r[3:5], (*r[3:5], r[2], r[5], r[0], r[1]))
    assert set(first.values()) == want


def test_findings_by_track_number(spark):
    """Tracks told apart by number alone give the same rows, where numbers are the fleet's own."""
    rows = risk.behaviours(tracks.contexts(spark, SF))
    f = rows.where("track_id % 3 <> 1").groupBy("camera_id", "track_id").agg(F.lit(2).alias("from_k")).withColumns({"nth": F.lit(1), "name": F.when(F.col("track_id") % 3 == 0, "X"), "points": F.lit(7), "detail": F.lit("x")})
    kept = lambda d: {tuple(r) for r in risk.risk(d).select("camera_id", "track_id", "event_id", "score", "reason", F.to_json("behaviours")).collect()}
    both = [risk.with_findings(rows, f), risk.with_findings(rows, f, by=("track_id",))]
    assert set(both[0].columns) == set(both[1].columns) and kept(both[0]) == kept(both[1]) and kept(both[0]) != kept(rows)
