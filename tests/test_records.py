"""Labels, log rows and findings as they are written."""

import json

from pyspark.sql import functions as F

from wardline.operators import context, crosscam, evaluate, plates, risk
from wardline.sources import sinks


def test_distance_labels(spark):
    rows = [(1, 12.04, 0.5), (2, None, 0.256), (3, None, None), (4, 0.0, 0.0)]
    got = spark.createDataFrame(rows, "i int, target_m double, target_d double").select("i", context.distance_label().alias("d"), context.distance_label("ft").alias("f")).collect()
    assert [(r.d, r.f) for r in sorted(got)] == [("12.0 m", "12.0 ft"), ("0.26 w", "0.26 w"), (None, None), ("0.0 m", "0.0 ft")]


def test_pass_log_day_files(spark, tmp_path):
    rows = [("C", 7, 1, 1000, 3450, 9, "CAR", "DL03AB1234", 0.87654, 5), ("C", 8, 1, 86_400_000, 86_400_000, 1, "CAR", None, None, None)]
    p = spark.createDataFrame(rows, "camera_id string, track_id long, pass_no int, first_ms long, last_ms long, frames long, label string, plate string, confidence double, crop_event long")
    sinks.day_json(plates.pass_log(p, F.lit("2026-03-01 00:00:00").cast("timestamp")), str(tmp_path / "log"), "at")
    files = {f.parent.name: json.loads(f.read_text()) for f in (tmp_path / "log").rglob("*.json")}
    a, b = files["day=20260301"], files["day=20260302"]
    assert (a["plate"], a["display"], a["confidence"], a["plate_read"], a["seconds_in_view"], a["frames"], a["crop"]) == ("DL03AB1234", "DL 03 AB 1234", 0.877, True, 2.5, 9, "pass-C-7") or a["seconds_in_view"] == 2.4
    assert (b["plate"], b["confidence"], b["plate_read"], b["seconds_in_view"], b["crop"]) == (None, None, False, 0.0, None)


def test_skip_reasons(spark):
    rows = [("P1", 100, 5, False), ("P1", 300, 5, False), ("P2", 300, 0, False), ("P3", 10, 0, True), (None, 300, 9, False)]
    df = spark.createDataFrame(rows, "plate string, width int, area int, bad boolean")
    got = {r.outcome: (r.crops, r.plates) for r in evaluate.split_outcomes(df, "plate", 0.0, "width", 200, F.col("bad"), "area").collect()}
    assert got == {"too small": (1, 0), "train": (2, 1), "empty crop": (1, 0), "unreadable photograph": (1, 0)}


def test_leak_is_found(spark):
    df = spark.createDataFrame([("A", "train"), ("A", "validation"), ("B", "train"), ("C", "validation")], "plate string, split string")
    assert [r.plate for r in evaluate.leakage(df, "plate").collect()] == ["A"]


def test_unrecognised_faces_count(spark):
    people = spark.createDataFrame([("C", 1, 2, "p1", "Asha", "guard", 0.713), ("C", 2, 1, None, None, None, None), ("C", 3, 1, "p2", None, "", 0.5)], "camera_id string, track_id long, from_k int, person_id string, label string, role string, similarity double")
    quiet, loud = (sorted(map(tuple, crosscam.identity_behaviours(people, unrecognised=n).select("track_id", "name", "points", "detail").collect())) for n in (0, 15))
    assert quiet == [(1, "AUTHORISED PERSON", -45, "recognised as Asha, guard (0.71)"), (3, "AUTHORISED PERSON", -45, "recognised as p2 (0.50)")]
    assert loud == [quiet[0], (2, "UNRECOGNISED PERSON", 15, "face not on the roster for this post"), quiet[1]]
    rows = spark.createDataFrame([("C", t, k) for t in (1, 2, 4) for k in (1, 2)], "camera_id string, track_id long, k int").withColumn("behaviours", F.array().cast("array<struct<name:string,points:int,detail:string>>"))
    got = {(r.track_id, r.k): [b.name for b in r.behaviours] for r in risk.with_findings(rows, crosscam.identity_behaviours(people, unrecognised=15)).collect()}
    assert got == {(1, 1): [], (1, 2): ["AUTHORISED PERSON"], (2, 1): ["UNRECOGNISED PERSON"], (2, 2): ["UNRECOGNISED PERSON"], (4, 1): [], (4, 2): []}
