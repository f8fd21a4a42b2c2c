"""Streaming forms of the folds, held against the batch forms: the same rows, in two files that are read one after the other."""

import random

import pytest
from pyspark.sql import functions as F

from wardline.operators import alerts, crosscam, integrity, links
from wardline.plans import fleetwide, tracks
from wardline.plans.fixtures import view
from wardline.streaming import twins

SF = "/root/testdata/sf0.001"
DAY = 86_400


@pytest.fixture
def flow(spark, tmp_path):
    """flow(df, order): df as a stream whose rows come in order, in two batches; got(stream): all that comes of it."""

    class Flow:
        n = 0

        def __call__(self, df, order):
            Flow.n += 1
            folder = str(tmp_path / f"in{Flow.n}")
            df = df.cache()
            middle = df.approxQuantile(order, [0.5], 0.0)[0]
            for part in (F.col(order) <= middle, F.col(order) > middle):
                df.where(part).coalesce(1).write.mode("append").parquet(folder)
            return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)

        def got(self, stream):
            Flow.n += 1
            rows = []
            twins.run_once(stream, lambda b, e: rows.extend(map(tuple, b.collect())), str(tmp_path / f"out{Flow.n}"))
            return sorted(rows, key=str)

    return Flow()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def at(seconds):
    return F.timestamp_seconds(F.col(seconds).cast("double") + DAY).alias("at")


def test_link_findings(spark, flow):
    states = links.changes(view(spark, SF, "fx_link"))
    want = rows(links.findings(states))
    s = flow(states.select("camera_id", F.col("event_id").cast("long"), F.col("at_s").cast("long"), "state", at("at_s")), "at_s")
    assert want and flow.got(twins.link_findings(s, late="1000 days")) == want


def test_tamper_alerts(spark, flow):
    scored = tracks.scored(spark, SF)
    bad = F.exists("behaviours", lambda b: b["name"] == "CAMERA TAMPERING").alias("tampering")
    s = flow(scored.select("camera_id", "track_id", "event_id", "k", F.col("stream_ms").cast("long"), bad, "severity", F.timestamp_seconds(F.col("k") + F.lit(DAY)).alias("at")), "k")
    want = rows(alerts.tamper_alerts(scored).select("camera_id", "track_id", "event_id", F.col("stream_ms").cast("long"), "severity"))
    assert want and flow.got(twins.tamper_alerts(s)) == want


def test_tracks(spark, flow, monkeypatch):
    kept = []
    monkeypatch.setattr(fleetwide.C, "assign_tracks", lambda d: kept.append(d))
    fleetwide.track_assign(spark, SF)
    d = kept[0]
    monkeypatch.undo()
    want = crosscam.assign_tracks(d)
    last = d.groupBy("camera_id").agg(F.max("frame").alias("end"))  # a camera's last frame is still open
    want = rows(want.join(last, "camera_id").where("frame < end").drop("end"))
    assert want and flow.got(twins.track_assign(flow(d.withColumn("at", at("frame")), "frame"), late="1 hour")) == want


def test_subjects(spark, flow):
    sights = [(p, 10 * i + p, "ABC"[(i + p) % 3], 40 * i, 40 * i + 5, [0.1 * (i % 4), 1 - 0.1 * (i % 4)]) for p in range(3) for i in range(60)]
    df = spark.createDataFrame(sights, "post long, id long, camera_id string, first_s long, last_s long, hist array<double>")
    assert flow.got(twins.link_subjects(flow(df.withColumn("at", at("first_s")), "first_s"))) == rows(crosscam.link_subjects(df))


def test_chain(spark, flow):
    df = spark.createDataFrame([(f"C{i % 3}", i, None if i % 5 == 0 else str(i), str(i), f"p{i}") for i in range(60)], "camera_id string, n long, event string, ts string, payload string")
    assert flow.got(twins.chain(flow(df.withColumn("at", at("n")), "n"), ["camera_id"], "n")) == rows(integrity.append(df, ["camera_id"], "n"))


def closing(df, **far):
    """df and a last row, a day on, by which the watermark passes all others."""
    last = df.limit(1)
    for c, v in far.items():
        last = last.withColumn(c, v)
    return df.unionByName(last)


def test_handoff(spark, flow):
    """An interval join of two streams under watermarks gives what the batch join gives."""
    looks = [[0.6, 0.4, 0.0], [0.0, 0.5, 0.5], [0.3, 0.3, 0.4], None]
    made = [(f"S{i % 2}", i, "ABC"[i % 3], float(7 * i), f"P{i % 11}", looks[i % 4]) for i in range(200)]
    df = spark.createDataFrame(made, "site string, id long, camera_id string, at_s double, plate string, hist array<double>")
    seen, read = df.where("id % 3 = 0").withColumnRenamed("id", "sighting_id").drop("plate"), df.where("id % 3 > 0").withColumnRenamed("id", "read_id")
    want = rows(crosscam.handoff(seen, read, by=("site",)).selectExpr("sighting_id", "plate", "read_by", "at_s", "round(similarity, 9)", "inferred"))
    far = {"site": F.lit("far"), "at_s": F.lit(90_000.0)}
    a, b = (flow(closing(x, **far).withColumn("at", at("at_s")), "at_s") for x in (seen, read))
    assert len(want) > 20 and flow.got(twins.handoff(a, b, ["site"]).withColumn("similarity", F.round("similarity", 9))) == want


def test_clips(spark, flow):
    frames = spark.createDataFrame([(f"C{c}", i + 1, 500 * i + c + 2000 * (i > 150)) for c in range(2) for i in range(200)], "camera_id string, frame_no long, at_ms long")
    fired = frames.where("frame_no % 37 = 5").selectExpr("camera_id", "frame_no * 10 as event_id", "at_ms")
    want = rows(alerts.clip_frames(fired, frames).select("camera_id", "event_id", "at_ms", "first_frame", "last_frame"))
    far = {"camera_id": F.lit("far"), "at_ms": F.lit(90_000_000).cast("long")}
    stamp = F.timestamp_millis(F.col("at_ms") + DAY * 1000)
    a, f = (flow(closing(x, **far).withColumn("at", stamp), "at_ms") for x in (fired, frames))
    assert want and flow.got(twins.clip_frames(a, f)) == want


def test_clips_of_sparse_frames(spark):
    """Frames far apart, before the first and after the last, against a scan of all frames."""
    draw, frames, fired = random.Random(6), [], []
    for c in range(3):
        t = 0
        for n in range(1, 80):
            t += draw.choice([40, 100, 3999, 4000, 4001, 59_999, 60_000, 200_000])
            frames.append((f"C{c}", n, t))
        fired += [(f"C{c}", 100 * c + k, draw.randint(0, t + 9000)) for k in range(60)]
    want = []
    for c, e, t in fired:
        mine = [x for x in frames if x[0] == c]
        upto, since = [n for _, n, f in mine if f <= t], [n for _, n, f in mine if f >= t + 4000]
        if upto:
            want.append((c, e, t, max(1, max(upto) - 39), min(since, default=79)))
    got = alerts.clip_frames(spark.createDataFrame(fired, "camera_id string, event_id long, at_ms long"), spark.createDataFrame(frames, "camera_id string, frame_no long, at_ms long"))
    assert got.columns == ["camera_id", "event_id", "at_ms", "first_frame", "last_frame"] and rows(got) == sorted(want, key=str)


def test_state_is_written_by_the_change(spark, flow):
    """Of a key's many entries, a batch that changes one writes one."""
    df = spark.createDataFrame([("C", i % 500, i, float(i)) for i in range(500)] + [("C", 7, 500, 500.0)], "camera_id string, zone long, n long, at_s double").withColumn("at", at("at_s"))

    def step(held, r):
        if r is not None:
            held["seen"][r.zone] = (held["seen"].get(r.zone, (0,))[0] + 1,)
        return [] if r is None or r.n < 500 else [(r.camera_id, len(held["seen"]), held["seen"][7][0])]

    kept = twins.Kept((), {"seen": ("zone bigint", "times bigint")})
    folder = flow(df, "n")
    assert flow.got(twins.fold(folder, ["camera_id"], step, "camera_id string, zones bigint, times bigint", ["n"], "at", kept, ttl_s=10_000)) == [("C", 500, 2)]
