"""Hand-worked cases of the rules."""

import json

import pytest
from pyspark.sql import functions as F

from wardline.functions import geometry as G
from wardline.functions import plates as P
from wardline.functions import text as X
from wardline.functions import vectors as V
from wardline.operators import crosscam, folds, integrity, links, plates, store
from wardline.operators.zones import resolve_labels
from wardline.sources import config, sinks
from wardline.streaming import twins

SQUARE = ((0.2, 0.2), (0.8, 0.2), (0.8, 0.8), (0.2, 0.8))


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize("x,y,want", [(0.5, 0.5, True), (0.2, 0.5, True), (0.8, 0.8, True), (0.1, 0.5, False), (0.9, 0.9, False)])
def test_inside(spark, x, y, want):
    assert one(spark, G.inside(F.lit(x), F.lit(y), SQUARE))[0] is want


def test_geometry(spark):
    assert one(spark, G.distance_to_polygon(F.lit(0.1), F.lit(0.5), SQUARE))[0] == pytest.approx(0.1)
    assert one(spark, G.compass(F.lit(0.0), F.lit(-1.0)), G.compass(F.lit(1.0), F.lit(0.0)), G.compass(F.lit(-1.0), F.lit(1.0))) == ("N", "E", "SW")
    assert one(spark, G.denormalize(F.lit(0.5), 5), G.track_label(F.lit(7)), G.track_label(F.lit(None).cast("long"))) == (2, "P007", "P---")
    m = G.homography((((0.1, 0.56), (0.0, 40.0)), ((0.95, 0.56), (12.0, 40.0)), ((1.0, 0.99), (12.0, 6.0)), ((0.05, 0.99), (0.0, 6.0))))
    assert one(spark, *G.project(F.lit(0.95), F.lit(0.56), m)) == pytest.approx((12.0, 40.0))
    with pytest.raises(ValueError):
        G.homography((((0, 0), (0, 0)),) * 4)
    assert one(spark, G.haversine_m(F.lit(28.613939), F.lit(77.209023), F.lit(28.614512), F.lit(77.209870)))[0] == pytest.approx(104.4, abs=1)


@pytest.mark.parametrize("raw,want", [
    ("MH 12 AB 1234", "MH12AB1234"), ("mh12ab1234", "MH12AB1234"), ("MHI2AB1234", "MH12AB1234"), ("OL8CAF5030", "DL8CAF5030"), ("22BH1234AA", "22BH1234AA"), ("TAXI", None), (None, None), ("XX99ZZ9999", None), ("DL9CZ2581", "DL9CZ2581"),
])
def test_normalise(spark, raw, want):
    df = P.normalised(spark.createDataFrame([(raw,)], "raw string"), "raw")
    assert df.first().plate == want
    if want == "MH12AB1234":
        assert df.select(P.display(F.col("plate")), P.state_of(F.col("plate"))).first() == ("MH 12 AB 1234", "MH")


def test_consensus(spark):
    def agreed(*reads):
        rows = [(1, r, i) for i, r in enumerate(reads)]
        return tuple(plates.consensus(spark.createDataFrame(rows, "t int, p string, k int"), ["t"], "p", "k").first())[1:]

    assert agreed("DL9CZ2581", "DL5CZ2581") == (None, 2)
    assert agreed("DL9CZ2581", "DL5CZ2581", "DL9CZ2581") == ("DL9CZ2581", 3)
    assert agreed("DL9CZ2581") == (None, 1)


def test_cooldown(spark):
    rows = [(1, i, i * 1000, 2 if i == 5 else 1) for i in range(34)]
    df = spark.createDataFrame(rows, "t int, event_id int, at int, rank int")
    assert [r.event_id for r in folds.cooldown(df, ["t"], "at", [], 30_000, "rank").orderBy("event_id").collect()] == [0, 5]
    assert [r.event_id for r in folds.cooldown(df, ["t"], "at", [], 30_000).orderBy("event_id").collect()] == [0, 30]


def test_suppression(spark):
    rows = [("C", 1, n, 0, last, 1, "P") for n, last in enumerate((0, 6000, 11000))]
    df = spark.createDataFrame(rows, "camera_id string, track_id int, pass_no int, first_ms int, last_ms int, frames int, plate string")
    assert sorted(r.last_ms for r in plates.suppress(df).collect()) == [0, 11000]


def test_links(spark):
    def found(*states):
        df = spark.createDataFrame([("C", i, t, s) for i, (t, s) in enumerate(states)], "camera_id string, event_id long, at_s long, state string")
        return [r.finding for r in links.findings(links.changes(df)).orderBy("event_id", "finding").collect()]

    assert found((0, "ONLINE"), (10, "RECONNECTING"), (14, "ONLINE")) == []
    assert found((0, "ONLINE"), (10, "RECONNECTING"), (22, "ONLINE")) == ["CAMERA LINK LOST"]
    assert found((0, "ONLINE"), (10, "RECONNECTING"), (12, "ONLINE"), (20, "RECONNECTING"), (22, "ONLINE"), (30, "RECONNECTING"), (32, "ONLINE")) == ["REPEATED LINK LOSS"]


def test_chain(spark):
    rows = spark.createDataFrame([("C", i, str(i), str(i * 10), f"p{i}") for i in range(8)], "camera_id string, n int, event string, ts string, payload string")
    c = integrity.append(rows, ["camera_id"], "n")
    assert integrity.verify(c, ["camera_id"]).count() == 0
    edited = c.withColumn("payload", F.when(F.col("n") == 3, "x").otherwise(F.col("payload")))
    assert [(r.event, r["break"]) for r in integrity.verify(edited, ["camera_id"]).collect()] == [("3", "contents changed")]
    assert [(r.event, r["break"]) for r in integrity.verify(c.where("n <> 5"), ["camera_id"]).collect()] == [("6", "previous changed or removed")]
    assert [r["break"] for r in integrity.verify(c.withColumn("hash", F.when(F.col("n") != 4, F.col("hash"))), ["camera_id"]).orderBy("event").collect()] == ["unchained", "previous changed or removed"]


def test_incident_tie(spark):
    df = spark.createDataFrame([(1, 0, "C", 1, 50, "MEDIUM", "a", None), (2, 60, "C", 1, 50, "MEDIUM", "b", None), (3, 181, "C", 1, 10, "LOW", "a", None)], "event_id int, at_s int, camera_id string, track_id int, score int, severity string, event_type_name string, plate string")
    got = store.incidents(df).orderBy("incident_id").collect()
    assert [(r.incident_id, r.events, r.peak_event_id, r.kinds) for r in got] == [(1, 2, 1, ["a", "b"]), (3, 1, 3, ["a"])]


def test_upsert_adds_columns(spark):
    old, new = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "event_id int, v string, seq int"), spark.createDataFrame([(2, "c", 2, "n")], "event_id int, v string, seq int, note string")
    assert {(r.event_id, r.v, r.note) for r in store.upsert(old, new).collect()} == {(1, "a", None), (2, "c", "n")}


def test_vectors(spark):
    a, b = F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(1.0), F.lit(0.0))
    got = one(spark, V.intersection(a, b), V.cosine(a, F.array(F.lit(0.0), F.lit(0.0))), V.blend(a, b), V.intersection(a, F.array(F.lit(1.0))))
    assert (got[0], got[1], got[3]) == (0.5, 0.0, 0.0) and got[2] == pytest.approx([0.65, 0.35])


def test_redact(spark):
    cases = {"rtsp://u:pw@h/1?token=x&b=2": "rtsp://u:***@h/1?token=***&b=2", "http://h/a?Password=x#f": "http://h/a?Password=***#f", "0": "0", "http://h/a@b:c": "http://h/a@b:c"}
    for raw, want in cases.items():
        assert one(spark, X.redact(F.lit(raw)))[0] == want


def test_labels():
    assert resolve_labels(["vehicle", "person", "car"]) == ["BICYCLE", "MOTORCYCLE", "CAR", "TRUCK", "BUS", "PERSON"]
    for bad in ([], ["boat"]):
        with pytest.raises(ValueError):
            resolve_labels(bad)


def test_tracker(spark):
    def det(frame, i, x, hist=None):
        return ("C", frame, i, 0.9, x, 0, x + 10, 20, hist)

    red, blue = [0.9, 0.1], [0.1, 0.9]
    rows = [det(0, 0, 0, red), det(0, 1, 100, blue), det(1, 2, 2, red), det(1, 3, 300, blue), *[det(f, 10 + f, 2, red) for f in range(2, 20)], det(20, 50, 600, blue)]
    got = {r.det_id: r.track_id for r in crosscam.assign_tracks(spark.createDataFrame(rows, "camera_id string, frame int, det_id long, confidence double, x1 int, y1 int, x2 int, y2 int, hist array<double>")).collect()}
    assert got[0] == got[2] == 1 and got[1] == 2 and got[3] == 3
    assert got[50] in (2, 3)


def test_subjects(spark):
    red, blue = [0.9, 0.1], [0.1, 0.9]
    rows = [(1, 1, "A", 0, 5, red), (1, 2, "B", 20, 25, red), (1, 3, "B", 40, 45, red), (1, 4, "A", 21, 25, blue)]
    got = {r.id: r.subject_id for r in crosscam.link_subjects(spark.createDataFrame(rows, "post long, id long, camera_id string, first_s long, last_s long, hist array<double>")).collect()}
    assert got == {1: "S0001", 2: "S0001", 4: "S0002", 3: "S0003"}


def test_sources(spark, tmp_path):
    (tmp_path / "z.json").write_text(json.dumps({"camera_id": "C", "calibration": {"points": [{"image": [0, 0], "world": [0, 0]}, {"image": [1, 0], "world": [2, 0]}, {"image": [1, 1], "world": [2, 2]}, {"image": [0, 1], "world": [0, 2]}]}, "zones": [{"name": "a", "kind": "restricted", "polygon": [[0, 0], [1, 0], [1, 1]]}, {"name": "b", "polygon": [[0, 0], [1, 2], [1, 1]]}]}))
    z = config.zones(spark, str(tmp_path / "z.json")).orderBy("position").collect()
    assert [(r["name"], r.kind, r.base_risk, r.valid) for r in z] == [("a", "RESTRICTED", 50, True), ("b", "WATCH", 50, False)]
    with pytest.raises(ValueError):
        config.zone_list(spark, str(tmp_path / "z.json"))
    assert one(spark, *G.project(F.lit(0.5), F.lit(0.5), config.calibration(spark, str(tmp_path / "z.json"))["C"])) == pytest.approx((1.0, 1.0))
    (tmp_path / "f.json").write_text(json.dumps({"base": {"stride": "2", "site": "s"}, "cameras": [{"camera_id": "A", "latitude": "1.5", "lon": "2"}, {"camera_id": "B", "stride": "5"}]}))
    fleet = config.cameras(spark, str(tmp_path / "f.json"))
    assert {(r.camera_id, r.stride) for r in fleet.collect()} == {("A", "2"), ("B", "5")}
    assert {(r.camera_id, r.lat) for r in config.places(fleet).collect()} == {("A", 1.5), ("B", None)}
    for bad in ([{"camera_id": "A"}, {"camera_id": "A"}], [{"camera_id": "A", "colour": "x"}]):
        (tmp_path / "g.json").write_text(json.dumps({"cameras": bad}))
        with pytest.raises(ValueError):
            config.cameras(spark, str(tmp_path / "g.json"))
    (tmp_path / "r.json").write_text(json.dumps({"vehicles": [{"plate": "a 1"}, {"plate": ""}, {"plate": "A1", "status": "stolen"}]}))
    assert [(r.plate, r.status) for r in config.registry(spark, str(tmp_path / "r.json")).collect()] == [("A1", "STOLEN")]
    (tmp_path / "p.json").write_text(json.dumps({"people": [{"id": "x", "vectors": [[1, 2], [3, 4]]}, {"id": "y", "vectors": []}]}))
    roster = config.roster(spark, str(tmp_path / "p.json"))
    assert [r.person_id for r in roster.collect()] == ["x", "x"]
    assert crosscam.upsert_roster(roster, roster.limit(1)).count() == 1
    (tmp_path / "a.xml").write_text("<annotation><filename>i.jpg</filename><object><name>mh 12 ab 1234</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3.7</xmax><ymax>4</ymax></bndbox></object><object><name>LICENCE</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object></annotation>")
    assert [tuple(r) for r in config.annotations(spark, str(tmp_path / "a.xml")).collect()] == [("i.jpg", "MH12AB1234", 1, 2, 3, 4)]


def test_fleet_file(spark, tmp_path):
    """Cameras with a nested place, notes, areas; what is wrong is refused."""
    at = {"lat": 10.5, "lon": "20.25", "bearing": 90, "fov": 60, "height": 4, "name": "North"}
    fleet = {"_note": "x", "base": {"stride": "2", "loiter_after": "9"}, "geofences": [{"name": "A", "polygon": [[10, 20], [11, 20], [11, 21]]}, {"points": [[0, 0], [1, 0], [0, 1]], "kind": "border"}],
             "cameras": [{"camera_id": "A", "source": "0", "location": at, "_why": "y"}, {"camera_id": "B", "source": "1", "stride": 5, "zones": "z.json"}]}
    (tmp_path / "f.json").write_text(json.dumps(fleet))
    c = config.cameras(spark, str(tmp_path / "f.json"))
    assert {(r.camera_id, r.lat, r.lon, r.bearing, r.fov, r.site) for r in config.places(c).collect()} == {("A", 10.5, 20.25, 90.0, 60.0, "North"), ("B", None, None, None, None, None)}
    assert {(r.camera_id, r.stride, r.loiter_after, r.height, r.zones) for r in c.collect()} == {("A", "2", "9", "4", None), ("B", "5", "9", None, "z.json")}
    areas = config.geofence_list(spark, str(tmp_path / "f.json"))
    assert [n for n, _ in areas] == ["A", "AREA"] and areas[0][1] == ((10.0, 20.0), (11.0, 20.0), (11.0, 21.0))
    assert [r.kind for r in config.geofences(spark, str(tmp_path / "f.json")).orderBy("position").collect()] == ["SECTOR", "BORDER"]
    for bad in ({"lat": "x", "lon": 1}, {"lat": 95, "lon": 1}, {"lat": 1}, {"lat": 1, "lon": 1, "colour": 2}):
        (tmp_path / "g.json").write_text(json.dumps({"cameras": [{"camera_id": "A", "location": bad}]}))
        with pytest.raises(ValueError):
            config.cameras(spark, str(tmp_path / "g.json"))
    (tmp_path / "h.json").write_text(json.dumps({"cameras": [], "geofences": [{"name": "A", "polygon": [[0, 0], [100, 0], [0, 1]]}]}))
    with pytest.raises(ValueError):
        config.geofence_list(spark, str(tmp_path / "h.json"))


def test_findings_reach_the_score(spark):
    """A flagged plate counts +45 from the row on that it is known at, an authorised person -45; a check without a finding nothing."""
    from wardline.operators import risk

    rows = [("C", t, k, "CAR", "R", "RESTRICTED", 40, 0.6, False) for t in (1, 2, 3) for k in (1, 2)]
    df = spark.createDataFrame(rows, "camera_id string, track_id long, k int, label string, zone string, zone_kind string, base_risk int, confidence double, night boolean")
    df = df.withColumn("behaviours", F.array().cast("array<struct<name:string,points:int,detail:string>>"))
    found = [("C", 1, 2, 1, "WATCHLISTED VEHICLE", 45, "d"), ("C", 2, 1, 2, "AUTHORISED PERSON", -45, "d"), ("C", 3, 1, 1, None, 0, "d")]
    f = spark.createDataFrame(found, "camera_id string, track_id long, from_k int, nth int, name string, points int, detail string")
    got = {(r.track_id, r.k): (r.score, r.severity, [b.name for b in r.behaviours]) for r in risk.risk(risk.with_findings(df, f)).collect()}
    assert got[1, 1] == (44, "MEDIUM", []) and got[1, 2] == (89, "HIGH", ["WATCHLISTED VEHICLE"])
    assert got[2, 1] == got[2, 2] == (0, "LOW", ["AUTHORISED PERSON"]) and got[3, 2] == got[1, 1]


def test_roster_in_blocks(spark):
    faces = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(30)], "face_id long, vec array<double>")
    roster = spark.createDataFrame([(f"p{i}", i, [float(i % 5), 1.0, float(i % 4)]) for i in range(23)], "person_id string, position long, vec array<double>")
    want = sorted(map(tuple, crosscam.match_roster(faces, roster).collect()))
    assert sorted(map(tuple, crosscam.match_roster(faces, roster, rows=4).collect())) == want


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "2026-01-01", 1, "a"), (2, "2026-01-02", 1, "b")], "event_id int, event_date string, seq int, v string")
    sinks.store(df, str(tmp_path / "s"))
    sinks.store(spark.createDataFrame([(2, "2026-01-02", 2, "c", "n")], "event_id int, event_date string, seq int, v string, note string"), str(tmp_path / "s"))
    got = spark.read.option("mergeSchema", True).parquet(str(tmp_path / "s"))
    assert {(r.event_id, r.v, r.note) for r in got.collect()} == {(1, "a", None), (2, "c", "n")}
    assert [p.name for p in tmp_path.iterdir()] == ["s"]  # what was staged is gone
    sinks.day_json(df.withColumn("at", F.to_timestamp("event_date")), str(tmp_path / "j"), "at")
    assert {str(r.day) for r in spark.read.json(str(tmp_path / "j")).collect()} == {"20260101", "20260102"}
    seen = []

    def broken(b, e):
        raise RuntimeError("down")

    assert len(sinks.fan_out(broken, lambda b, e: seen.append(b.count()))(df, 0)) == 1 and seen == [2]


def test_stream_equals_batch(spark, tmp_path):
    """The streaming alerts, link changes and suppressed passes equal those of the batch operators."""
    from wardline.operators import alerts
    from wardline.plans import tracks, vehicles
    from wardline.plans.fixtures import view

    sf = "/root/testdata/sf0.001"

    def through(df, twin, name):
        df.coalesce(1).write.parquet(str(tmp_path / name))
        got = []
        s = spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
        twins.run_once(twin(s), lambda b, e: got.extend(map(tuple, b.collect())), str(tmp_path / f"{name}-c"))
        return sorted(got)

    day = 86_400  # a first row at the epoch would be late
    at = F.timestamp_seconds(F.col("stream_ms") / 1000 + day).alias("at")
    scored = tracks.scored(spark, sf)
    rows = scored.select("camera_id", "track_id", "event_id", "k", F.col("stream_ms").cast("long").alias("stream_ms"), "zone", "zone_kind", "severity", at)
    want = alerts.fence_alerts(scored).select("camera_id", "track_id", "event_id", F.col("stream_ms").cast("long"), "severity")
    assert through(rows, twins.fence_alerts, "alerts") == sorted(map(tuple, want.collect()))
    state = view(spark, sf, "fx_link").select("camera_id", "event_id", "state", F.timestamp_seconds(F.col("at_s").cast("double") + day).alias("at"))
    assert through(state, twins.link_changes, "links") == sorted(map(tuple, links.changes(state).select("camera_id", "event_id", "state").collect()))
    p = plates.passes(vehicles._sightings(spark, sf)).withColumn("pass_key", F.coalesce("plate", F.concat_ws("#", "camera_id", F.col("track_id").cast("string"))))
    p = p.select("pass_key", F.col("first_ms").cast("long").alias("first_ms"), F.col("last_ms").cast("long").alias("last_ms"), F.timestamp_seconds(F.col("last_ms") / 1000 + day).alias("at"))
    want = sorted(map(tuple, vehicles.pass_suppression(spark, sf, vehicles._sightings).select("pass_key", "last_ms").collect()))
    assert through(p, twins.suppressed_passes, "passes") == want
    one = view(spark, sf, "fx_obs").select("camera_id", "track_id", at)
    assert sum(r[-1] for r in through(one, twins.passes, "sessions")) <= one.count()


def test_detections_push_down(spark, tmp_path, capsys):
    rows = [("C", 1, None, 0.1, label, conf, (1, 2, 3, 4), 1) for label, conf in (("CAR", 0.9), ("CAR", 0.2), ("DOG", 0.9))]
    spark.createDataFrame(rows, config.DETECTIONS).write.parquet(str(tmp_path / "d"))
    got = config.detections(spark, str(tmp_path / "d"), resolve_labels(["vehicle"]))
    assert [r.confidence for r in got.collect()] == [0.9]
    got.explain("formatted")
    assert "GreaterThanOrEqual(confidence,0.4)" in capsys.readouterr().out


def test_payload_keeps_nulls(spark):
    from wardline.operators.alerts import payload

    got = one(spark, payload(id=F.lit(1), zone=F.lit(None).cast("string"), box=F.struct(F.lit(2).alias("x1"))))[0]
    assert json.loads(got) == {"id": 1, "zone": None, "box": {"x1": 2}}


def test_one_shuffle_by_track(spark):
    from wardline.plans import tracks

    plan = tracks.scored(spark, "/root/testdata/sf0.001").select("event_id", "score")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2  # the fixture's own, and the tracks'


def test_live_summaries(spark, tmp_path):
    rows = [("A", "HIGH", 70, 86_400 + i) for i in range(5)] + [("B", "LOW", 10, 86_400 + 90)]
    df = spark.createDataFrame(rows, "camera_id string, severity string, score int, s long").withColumn("at", F.timestamp_seconds("s")).drop("s")
    df.coalesce(1).write.parquet(str(tmp_path / "a"))
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "a"))
    got, minutes = [], []
    twins.run_once(twins.live_summary(read()), lambda b, e: got.extend(map(tuple, b.collect())), str(tmp_path / "c1"), "update")
    assert sorted(got) == [("A", "HIGH", 5, 70), ("B", "LOW", 1, 10)]
    twins.run_once(twins.per_minute(read()), lambda b, e: minutes.extend(b.collect()), str(tmp_path / "c2"))
    assert [(r.camera_id, r.alerts) for r in minutes] == [("A", 5)]
