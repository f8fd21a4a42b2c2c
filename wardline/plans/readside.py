"""Queries over alerts and the event store."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wardline.operators import alerts as A
from wardline.operators import store as S
from wardline.plans import tracks as T
from wardline.plans.fixtures import view
from wardline.plans.tracks import sql


def _fired(df):
    return df.select("event_id", "camera_id", "track_id", F.col("stream_ms").cast("long").alias("stream_ms"), "severity", "score")


def fence_alerts(spark, sf_dir):
    return _fired(A.fence_alerts(T.scored(spark, sf_dir)))


def tamper_alerts(spark, sf_dir):
    return _fired(A.tamper_alerts(T.scored(spark, sf_dir)))


def all_alerts(spark, sf_dir):
    """Fence and tampering alerts together."""
    return A.track_alerts(T.scored(spark, sf_dir)).groupBy("camera_id", "kind", "severity").agg(F.count("*").alias("n"), F.max("score").alias("peak"))


def change_log(spark, sf_dir):
    return A.changes(T.scored(spark, sf_dir)).select("event_id", "zone", F.size("behaviours").alias("n_behaviours"))


def confirm_window(spark, sf_dir):
    """Cameras whose frame rate makes the confirmation window long."""
    o = view(spark, sf_dir, "fx_obs").groupBy("camera_id").agg(F.count("*").alias("frames"), F.countDistinct("track_id").alias("tracks"), (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("seconds"))
    o = o.withColumn("confirm_s", F.round(3 * F.col("seconds") / F.col("frames"), 6))
    return o.where("frames >= 40 and confirm_s >= 1.5")


def alert_enriched(spark, sf_dir):
    a = view(spark, sf_dir, "fx_alert")
    own = a.where("plate is not null").select("camera_id", "track_id", "plate").distinct()
    fleet = view(spark, sf_dir, "fx_obs").join(view(spark, sf_dir, "fx_plate").where("track_id % 6 = 3"), "track_id").select("camera_id", "track_id", F.col("true_plate").alias("plate")).distinct()
    e = A.enrich(a.drop("plate"), own, fleet, view(spark, sf_dir, "fx_registry"))
    return e.select("event_id", "plate", "inferred", "known", "vehicle_class", "status", "score")


def alert_people(spark, sf_dir):
    """Alerts with who their track is and the subject that it was linked to."""
    a, o = view(spark, sf_dir, "fx_alert"), view(spark, sf_dir, "fx_obs")
    tracks = o.select("camera_id", "track_id").distinct()
    none = a.where("false").select("camera_id", "track_id", "plate")
    who = tracks.where("track_id % 9 = 0").withColumn("person_id", F.col("track_id") % 8)
    group = (F.col("track_id") % 40).alias("g")
    cameras = tracks.where("track_id % 4 = 0").select(group, "camera_id").groupBy("g").agg(F.array_sort(F.collect_set("camera_id")).alias("cameras"))
    subjects = tracks.where("track_id % 4 = 0").select("*", group).join(cameras, "g").withColumn("subject_id", F.format_string("S%04d", "g"))
    e = A.enrich(a.drop("plate"), none, none, view(spark, sf_dir, "fx_registry"), who, subjects)
    return e.select("event_id", "person_id", "identified", "subject_id", F.array_join("subject_cameras", ",").alias("subject_cameras"), "subject_inferred")


def clip_manifest(spark, sf_dir):
    """Frames of each alert's clip, and its evidence name."""
    o = view(spark, sf_dir, "fx_obs")
    frames = o.select("camera_id", F.row_number().over(Window.partitionBy("camera_id").orderBy("event_id")).alias("frame_no"), (F.col("event_id") * 100).alias("at_ms"))
    a = view(spark, sf_dir, "fx_alert").join(o.select("event_id", "ts"), "event_id").select("event_id", "camera_id", "ts", (F.col("event_id") * 100).alias("at_ms"))
    c = A.clip_frames(a, frames)
    return c.select("event_id", "first_frame", "last_frame", A.evidence_name(F.col("ts"), F.col("camera_id"), F.col("event_id"), ".mp4").alias("clip"))


def recent_events(spark, sf_dir):
    return S.search(view(spark, sf_dir, "fx_alert"), camera="CAM-02", severity="critical", since=100, limit=100).select("event_id", "at_s", "severity", "score")


def vehicle_history(spark, sf_dir):
    a = view(spark, sf_dir, "fx_alert").where("plate is not null")
    w = Window.partitionBy("plate").orderBy(F.desc("at_s"), F.desc("event_id"))
    return a.withColumn("nth", F.row_number().over(w)).where("nth <= 10").select("plate", "nth", "event_id", "at_s")


def store_summary(spark, sf_dir):
    return S.summary(view(spark, sf_dir, "fx_alert"))


def behaviour_counts(spark, sf_dir):
    b = T.scored(spark, sf_dir).select(F.explode("behaviours.name").alias("b"))
    return S.counts(b, "b", "behaviour")


def plates_seen(spark, sf_dir):
    return S.counts(view(spark, sf_dir, "fx_alert"), "plate", "plate")


def store_upsert(spark, sf_dir):
    """Stored alerts with a third of them written again, with a column that the old rows lack."""
    a = view(spark, sf_dir, "fx_alert").select("event_id", "camera_id", "score", F.lit(1).alias("seq"))
    again = a.where("event_id % 3 = 0").select("event_id", "camera_id", (F.col("score") + 1).alias("score"), F.lit(2).alias("seq"), F.lit("review").alias("note"))
    return S.upsert(a, again).select("event_id", "camera_id", "score", "seq", "note")


def store_upsert_any_version(spark, sf_dir):
    """New rows replace stored ones of an equal or a higher version."""
    a = view(spark, sf_dir, "fx_alert").select("event_id", "camera_id", "score", F.lit(2).alias("seq"))
    again = a.where("event_id % 3 < 2").select("event_id", "camera_id", (F.col("score") + 1).alias("score"), (2 - F.col("event_id") % 3).cast("int").alias("seq"))
    return S.upsert(a, again)


def incidents(spark, sf_dir):
    i = S.incidents(view(spark, sf_dir, "fx_alert").drop("label"))
    return i.withColumns({"cameras": F.array_join("cameras", ","), "kinds": F.array_join("kinds", ",")})


def event_by_id(spark, sf_dir):
    """The first event of each camera, looked up by its id."""
    a = view(spark, sf_dir, "fx_alert")
    return a.join(a.groupBy("camera_id").agg(F.min("event_id").alias("event_id")).select("event_id"), "event_id", "left_semi").select("event_id", "camera_id", "track_id", "score", "severity")


def alerts_per_minute(spark, sf_dir):
    """Tumbling one-minute counts of alerts by camera."""
    a = view(spark, sf_dir, "fx_alert").withColumn("at", F.timestamp_seconds("at_s"))
    return a.groupBy("camera_id", F.window("at", "1 minute")).agg(F.count("*").alias("alerts")).select("camera_id", F.unix_timestamp("window.start").alias("minute_s"), "alerts")


QUERIES = {f.__name__: f for f in (fence_alerts, tamper_alerts, all_alerts, change_log, confirm_window, alert_enriched, alert_people, clip_manifest, recent_events, vehicle_history, store_summary, behaviour_counts, plates_seen, store_upsert, store_upsert_any_version, incidents, event_by_id, alerts_per_minute)}

SCORED = (*T.TO_CTX, T.BEH, T.RISK)
_RANK = "CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END"


def _stepped(eligible: str, key: str, name: str) -> str:
    return f"""{name}_e AS ({eligible}), {name}_n AS (SELECT *, {_RANK} AS rnk, dense_rank() OVER (ORDER BY {key}) AS ky, row_number() OVER (PARTITION BY {key} ORDER BY stream_ms, event_id) AS rn FROM {name}_e),
{name}_f AS (SELECT ky, rn, event_id, stream_ms AS la, rnk AS lr, true AS fire FROM {name}_n WHERE rn = 1 UNION ALL
  SELECT n.ky, n.rn, n.event_id, CASE WHEN n.stream_ms - la >= 30000 OR n.rnk > lr THEN n.stream_ms ELSE la END, CASE WHEN n.stream_ms - la >= 30000 OR n.rnk > lr THEN n.rnk ELSE lr END, n.stream_ms - la >= 30000 OR n.rnk > lr
  FROM {name}_f f JOIN {name}_n n ON n.ky = f.ky AND n.rn = f.rn + 1)"""


FENCE = _stepped("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY camera_id, track_id, seg, stay ORDER BY k) AS run FROM rk WHERE zone IS NOT NULL) WHERE run >= 3 AND zone_kind = 'RESTRICTED'", "camera_id, track_id, seg, zone", "fe")
TAMPER = _stepped("""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY camera_id, track_id, seg, bout ORDER BY k) AS run FROM (SELECT *, sum(CASE WHEN b5 > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY camera_id, track_id, seg ORDER BY k) AS bout FROM rk) WHERE b5 > 0) WHERE run >= 3""", "camera_id, track_id, seg", "ta")
_REC = "WITH RECURSIVE "
_rec = lambda s: s.replace("WITH ", _REC, 1)
_FIRED = "SELECT event_id, camera_id, track_id, CAST(stream_ms AS BIGINT) AS stream_ms, severity, score FROM rk WHERE event_id IN (SELECT event_id FROM {0}_f WHERE fire)"
ORACLE = {
    "fence_alerts": _rec(sql(_FIRED.format("fe"), *SCORED, FENCE)),
    "tamper_alerts": _rec(sql(_FIRED.format("ta"), *SCORED, TAMPER)),
    "all_alerts": _rec(sql(f"SELECT camera_id, kind, severity, count(*) AS n, max(score) AS peak FROM (SELECT *, 'fence' AS kind FROM ({_FIRED.format('fe')}) UNION ALL SELECT *, 'tamper' AS kind FROM ({_FIRED.format('ta')})) GROUP BY 1, 2, 3", *SCORED, FENCE, TAMPER)),
    "change_log": sql("SELECT event_id, zone, CAST(len(bs) AS INT) AS n_behaviours FROM (SELECT *, lag(zone) OVER w AS pz0, lag(bs) OVER w AS pb, lag(k) OVER w AS pk0 FROM rk WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY k)) WHERE pk0 IS NULL OR zone IS DISTINCT FROM pz0 OR list_transform(bs, lambda x: x.name) <> list_transform(pb, lambda x: x.name)", *SCORED),
    "confirm_window": sql("SELECT * FROM (SELECT *, round(3 * seconds / frames, 6) AS confirm_s FROM (SELECT camera_id, count(*) AS frames, count(DISTINCT track_id) AS tracks, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS seconds FROM fx_obs GROUP BY 1)) WHERE frames >= 40 AND confirm_s >= 1.5"),
    "alert_enriched": sql("""SELECT a.event_id, coalesce(a.plate, f.plate) AS plate, a.plate IS NULL AND f.plate IS NOT NULL AS inferred, r.status IS NOT NULL AS known, r.vehicle_class, r.status, a.score FROM fx_alert a
  LEFT JOIN (SELECT DISTINCT camera_id, track_id, true_plate AS plate FROM fx_obs JOIN fx_plate USING (track_id) WHERE track_id % 6 = 3) f ON a.camera_id = f.camera_id AND a.track_id = f.track_id LEFT JOIN fx_registry r ON r.plate = coalesce(a.plate, f.plate)"""),
    "alert_people": sql("""SELECT a.event_id, CASE WHEN a.track_id % 9 = 0 THEN a.track_id % 8 END AS person_id, a.track_id % 9 = 0 AS identified, CASE WHEN a.track_id % 4 = 0 THEN format('S{:04d}', a.track_id % 40) END AS subject_id,
  CASE WHEN a.track_id % 4 = 0 THEN s.cams END AS subject_cameras, coalesce(a.track_id % 4 = 0 AND s.n > 1, false) AS subject_inferred FROM fx_alert a
  LEFT JOIN (SELECT track_id % 40 AS g, string_agg(DISTINCT camera_id, ',' ORDER BY camera_id) AS cams, count(DISTINCT camera_id) AS n FROM fx_obs WHERE track_id % 4 = 0 GROUP BY 1) s ON a.track_id % 40 = s.g"""),
    "clip_manifest": sql("""SELECT a.event_id, CAST(greatest(f.n - 39, 1) AS INT) AS first_frame, CAST(coalesce((SELECT min(g.n) FROM fr g WHERE g.camera_id = f.camera_id AND g.at_ms >= f.at_ms + 4000), f.top) AS INT) AS last_frame, strftime(f.ts, '%Y%m%d-%H%M%S') || '_' || a.camera_id || '_' || a.event_id || '.mp4' AS clip
  FROM fx_alert a JOIN fr f USING (event_id)""", "fr AS (SELECT event_id, camera_id, ts, event_id * 100 AS at_ms, row_number() OVER (PARTITION BY camera_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY camera_id) AS top FROM fx_obs)"),
    "recent_events": sql("SELECT event_id, at_s, severity, score FROM fx_alert WHERE camera_id = 'CAM-02' AND severity = 'CRITICAL' AND at_s >= 100 ORDER BY at_s DESC, event_id DESC LIMIT 100"),
    "vehicle_history": sql("SELECT plate, CAST(nth AS INT) AS nth, event_id, at_s FROM (SELECT *, row_number() OVER (PARTITION BY plate ORDER BY at_s DESC, event_id DESC) AS nth FROM fx_alert WHERE plate IS NOT NULL) WHERE nth <= 10"),
    "store_summary": sql("SELECT 'total' AS kind, NULL AS value, count(*) AS events, max(at_s) AS latest FROM fx_alert UNION ALL SELECT 'severity', severity, count(*), max(at_s) FROM fx_alert GROUP BY 2 UNION ALL SELECT 'camera', camera_id, count(*), max(at_s) FROM fx_alert GROUP BY 2"),
    "behaviour_counts": sql("SELECT x.name AS behaviour, count(*) AS n FROM (SELECT unnest(bs) AS x FROM beh) GROUP BY 1", *T.TO_CTX, T.BEH),
    "plates_seen": sql("SELECT plate, count(*) AS n FROM fx_alert WHERE plate IS NOT NULL GROUP BY 1"),
    "store_upsert_any_version": sql("SELECT event_id, camera_id, CASE WHEN event_id % 3 < 2 THEN score + 1 ELSE score END AS score, CAST(CASE WHEN event_id % 3 = 1 THEN 1 ELSE 2 END AS INT) AS seq FROM fx_alert"),
    "store_upsert": sql("SELECT event_id, camera_id, CASE WHEN event_id % 3 = 0 THEN score + 1 ELSE score END AS score, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS seq, CASE WHEN event_id % 3 = 0 THEN 'review' END AS note FROM fx_alert"),
    "incidents": sql("""SELECT arg_min(event_id, (at_s, event_id)) AS incident_id, min(at_s) AS started, max(at_s) AS ended, count(*) AS events, any_value(plate) AS plate, max(score) AS peak_score, arg_max(severity, (score, -at_s, -event_id)) AS peak_severity, arg_max(event_id, (score, -at_s, -event_id)) AS peak_event_id,
  array_to_string(list_distinct_in(list(camera_id ORDER BY at_s, event_id)), ',') AS cameras, array_to_string(list_distinct_in(list(event_type_name ORDER BY at_s, event_id)), ',') AS kinds FROM g GROUP BY ky, i""".replace("list_distinct_in(list(camera_id ORDER BY at_s, event_id))", "list_filter(list(camera_id ORDER BY at_s, event_id), lambda x, j: list_position(list(camera_id ORDER BY at_s, event_id), x) = j)").replace("list_distinct_in(list(event_type_name ORDER BY at_s, event_id))", "list_filter(list(event_type_name ORDER BY at_s, event_id), lambda x, j: list_position(list(event_type_name ORDER BY at_s, event_id), x) = j)"),
        "g AS (SELECT *, sum(nw) OVER (PARTITION BY ky ORDER BY at_s, event_id) AS i FROM (SELECT *, CASE WHEN at_s - lag(at_s) OVER (PARTITION BY ky ORDER BY at_s, event_id) <= 120 THEN 0 ELSE 1 END AS nw FROM (SELECT *, coalesce('p' || plate, camera_id || '#' || track_id) AS ky FROM fx_alert)))"),
    "event_by_id": sql("SELECT event_id, camera_id, track_id, score, severity FROM fx_alert WHERE event_id IN (SELECT min(event_id) FROM fx_alert GROUP BY camera_id)"),
    "alerts_per_minute": sql("SELECT camera_id, CAST(floor(at_s / 60) * 60 AS BIGINT) AS minute_s, count(*) AS alerts FROM fx_alert GROUP BY 1, 2"),
}
