"""When a situation becomes an alert, and what an alert carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import geometry as G
from wardline.model import DEFAULT, Policy
from wardline.operators import folds
from wardline.operators.context import TRACK
from wardline.operators.risk import severity, severity_rank


def confirmed(scored: DataFrame, policy: Policy, order: str) -> DataFrame:
    """scored with rank, fence and tamper: whether a row is at least the confirm-th consecutive one of its track in an armed zone, or of
    camera tampering. All of it looks at a track's segment in order, as the windows before it did, so nothing is sorted again."""
    n, w = max(policy.confirm, 1), Window.partitionBy(*TRACK, "seg").orderBy(order)
    rows = scored.withColumns({"bad": F.exists("behaviours", lambda b: b["name"] == "CAMERA TAMPERING"), "rank": severity_rank(F.col("severity"))})
    rows = rows.withColumns({"_then": F.lag("stay", n - 1).over(w), "_bad": F.sum(F.col("bad").cast("int")).over(w.rowsBetween(1 - n, 0))})
    fence = F.col("zone").isNotNull() & (F.col("_then") == F.col("stay")) & F.col("zone_kind").isin(*policy.alert_kinds)
    return rows.withColumns({"fence": F.coalesce(fence, F.lit(False)), "tamper": F.coalesce(F.col("_bad") == n, F.lit(False))}).drop("_then", "_bad")


def fence_alerts(scored: DataFrame, policy: Policy = DEFAULT, time: str = "stream_ms", order: str = "k") -> DataFrame:
    """Alerts of tracks in armed zones: from the confirm-th consecutive observation in the zone, then after the cooldown or at a
    higher severity than last reported. Leaving the zone resets the count, not the cooldown; a forgotten track resets both."""
    return folds.cooldown(confirmed(scored, policy, order).where("fence"), [*TRACK, "seg", "zone"], time, ["severity", "score"], policy.cooldown_s * 1000, "rank")


def tamper_alerts(scored: DataFrame, policy: Policy = DEFAULT, time: str = "stream_ms", order: str = "k") -> DataFrame:
    """The same for consecutive observations of camera tampering, wherever the track is."""
    return folds.cooldown(confirmed(scored, policy, order).where("tamper"), [*TRACK, "seg"], time, ["severity", "score"], policy.cooldown_s * 1000, "rank")


def track_alerts(scored: DataFrame, policy: Policy = DEFAULT, time: str = "stream_ms", order: str = "k") -> DataFrame:
    """fence_alerts and tamper_alerts (column kind: fence, tamper) from one pass over the scored rows; each has a cooldown of its own."""
    kinds = F.array_compact(F.array(F.when(F.col("fence"), "fence"), F.when(F.col("tamper"), "tamper")))
    rows = confirmed(scored, policy, order).where("fence or tamper").withColumn("kind", F.explode(kinds)).withColumn("zone", F.when(F.col("kind") == "fence", F.col("zone")))
    return folds.cooldown(rows, ["kind", *TRACK, "seg", "zone"], time, ["severity", "score"], policy.cooldown_s * 1000, "rank")


def link_alerts(findings: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """An alert for each link change with findings (camera_id, event_id, at_s, finding, points, night): the camera itself is the subject.
    Rows (camera_id, event_id, at_s, event_type_name, findings, score, severity); the first finding names the alert."""
    order = F.when(F.col("finding") == "REPEATED LINK LOSS", 1).otherwise(0)
    out = findings.groupBy("camera_id", "event_id", "at_s").agg(
        F.min_by("finding", order).alias("event_type_name"), F.count("*").alias("findings"),
        F.greatest(F.lit(0), F.least(F.lit(100), policy.zoneless_base + F.sum("points") + F.when(F.max("night"), policy.night_bonus).otherwise(0))).cast("int").alias("score"))
    return out.withColumn("severity", severity(F.col("score"), policy))


def changes(scored: DataFrame, order: str = "k") -> DataFrame:
    """Rows whose (zone, set of behaviours) differs from the track's row before."""
    state = F.struct("zone", F.array_sort(F.transform("behaviours", lambda b: b["name"])))
    w = Window.partitionBy(*TRACK).orderBy(order)
    return scored.withColumn("_s", state).withColumn("_p", F.lag("_s").over(w)).where(~F.col("_s").eqNullSafe(F.col("_p"))).drop("_s", "_p")


def clip_frames(alerts: DataFrame, frames: DataFrame, pre: int = 40, post_ms: int = 4000) -> DataFrame:
    """alerts (camera_id, at_ms, ...) with first_frame, last_frame: up to `pre` frames that end with the alert's, and those after
    it through the first one at least post_ms later (the camera's last if none is). frames: (camera_id, frame_no, at_ms), where
    frame_no counts up without gaps in each camera, in order of at_ms. An alert before its camera's first frame has no clip."""
    sides = [F.struct(F.lit(n).alias("side"), (F.col("at_ms") + add).alias("t")) for n, add in (("pre", 0), ("post", post_ms))]
    probes = alerts.select("camera_id", "at_ms").distinct().select("camera_id", "at_ms", F.explode(F.array(*sides)).alias("p")).select("camera_id", "at_ms", "p.*")
    near = nearest_frames(probes, frames).groupBy("camera_id", "at_ms").agg(
        F.max(F.when(F.col("side") == "pre", F.col("upto"))).alias("own"), F.max(F.when(F.col("side") == "post", F.coalesce("since", "upto"))).alias("last_frame"))
    out = alerts.join(near, ["camera_id", "at_ms"]).where("own is not null")
    return out.withColumn("first_frame", F.greatest(F.col("own") - (pre - 1), F.lit(1))).select(*alerts.columns, "first_frame", "last_frame")


def nearest_frames(probes: DataFrame, frames: DataFrame, cell_ms: int = 60_000) -> DataFrame:
    """probes (camera_id, t, ...) with upto, the last frame at t or before, and since, the first at t or after, as frame numbers; null where
    there is none. A range join by cells of time: a probe meets the frames of its own cell, and beyond that only the ends of its
    camera's cells, of which there are few. Only those are ordered by camera."""
    cell = lambda c: F.floor(F.col(c) / cell_ms).alias("cell")
    probes = probes.withColumn("cell", cell("t"))
    f = frames.select("camera_id", cell("at_ms"), F.col("at_ms").alias("f_ms"), "frame_no")
    ends = f.groupBy("camera_id", "cell").agg(F.max("frame_no").alias("high"), F.min("frame_no").alias("low"))
    empty = probes.select("camera_id", "cell").distinct().join(ends, ["camera_id", "cell"], "left_anti").select("camera_id", "cell", F.lit(None).cast("long").alias("high"), F.lit(None).cast("long").alias("low"))
    w = Window.partitionBy("camera_id").orderBy("cell")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    beyond = ends.unionByName(empty).select("camera_id", "cell", F.max("high").over(before).alias("before"), F.min("low").over(after).alias("after"))
    here = probes.select("camera_id", "cell", "t").distinct().join(f, ["camera_id", "cell"]).groupBy("camera_id", "t").agg(
        F.max(F.when(F.col("f_ms") <= F.col("t"), F.col("frame_no"))).alias("upto"), F.min(F.when(F.col("f_ms") >= F.col("t"), F.col("frame_no"))).alias("since"))
    out = probes.join(here, ["camera_id", "t"], "left").join(beyond, ["camera_id", "cell"])
    return out.select(*[c for c in probes.columns if c != "cell"], F.coalesce("upto", "before").alias("upto"), F.coalesce("since", "after").alias("since"))


def evidence_name(at, camera, event, suffix: str = ""):
    """yyyyMMdd-HHmmss_camera_event and a suffix."""
    return F.concat(F.date_format(at, "yyyyMMdd-HHmmss"), F.lit("_"), camera, F.lit("_"), event.cast("string"), F.lit(suffix))


def enrich(alerts: DataFrame, own: DataFrame, fleet: DataFrame, registry: DataFrame, identities: DataFrame | None = None, subjects: DataFrame | None = None) -> DataFrame:
    """Alerts with the plate of their track (its own reads before the fleet's) and that plate's registry row, if any; with who the
    track is, and with the subject it was linked to and the cameras that have seen it.

    own, fleet: (camera_id, track_id, plate); identities: (camera_id, track_id, person_id); subjects: (camera_id, track_id, subject_id,
    cameras), a row for each track; registry: (plate, vehicle_class, status). A link over several cameras is inferred
    (subject_inferred). Vectors stay where they are.
    """
    keys = ["camera_id", "track_id"]
    out = alerts.join(own.withColumnRenamed("plate", "own_plate"), keys, "left").join(fleet.withColumnRenamed("plate", "fleet_plate"), keys, "left")
    out = out.withColumn("plate", F.coalesce("own_plate", "fleet_plate")).withColumn("inferred", F.col("own_plate").isNull() & F.col("fleet_plate").isNotNull())
    out = out.join(registry, "plate", "left").withColumn("known", F.col("status").isNotNull())
    if identities is not None:
        out = out.join(identities.select(*keys, "person_id"), keys, "left").withColumn("identified", F.col("person_id").isNotNull())
    if subjects is not None:
        out = out.join(subjects.select(*keys, "subject_id", F.col("cameras").alias("subject_cameras")), keys, "left")
        out = out.withColumn("subject_inferred", F.coalesce(F.size("subject_cameras") > 1, F.lit(False)))
    return out


def event_json() -> Column:
    """The nested record of a scored row, with the places that its measures are kept to; a row without a track has no context."""
    c = F.col
    r = lambda name, n: F.round(c(name), n).alias(name)
    context = F.struct(r("speed", 4), c("heading"), F.round("dwell_s", 2).alias("dwell_seconds"), F.round("age_s", 2).alias("track_age_seconds"), F.round("target_d", 4).alias("distance_to_target"), c("target").alias("target_zone"),
                       c("approaching"), F.round("variance", 3).alias("heading_variance"), c("samples"), F.round("hr", 3).alias("height_ratio"), F.round("growth", 4).alias("camera_growth"), F.round("speed_mps", 3).alias("speed_mps"), F.round("target_m", 2).alias("distance_to_target_m"))
    return payload(
        event_id=c("event_id"), timestamp=F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), camera_id=c("camera_id"),
        object=F.when(c("label").isNotNull(), F.struct("label", F.round("confidence", 4).alias("confidence"), "track_id", G.track_label(c("track_id")).alias("track_label"))),
        zone=F.when(c("zone").isNotNull(), F.struct(c("zone").alias("name"), c("zone_kind").alias("kind"), "base_risk")),
        risk=F.struct("score", "severity", "reason", F.transform("factors", lambda f: F.struct(f["name"].alias("label"), f["points"].alias("points"), f["detail"].alias("detail"))).alias("factors")),
        context=F.when(c("track_id").isNotNull(), context), behaviours=c("behaviours"),
    )


def payload(**columns):
    """Nested JSON text of an event; null fields stay in it."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in columns.items()]), {"ignoreNullFields": "false"})
