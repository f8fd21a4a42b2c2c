"""The read side: what was recorded, by event, incident and summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(stored: DataFrame | None, new: DataFrame, key: str = "event_id", version: str = "seq", replace: bool = True) -> DataFrame:
    """stored with new rows in place of those of the same key. Of several new rows the highest version wins, of equal versions the one
    whose columns hash highest, the same at each try. A new row replaces a stored one whatever its version; with replace=False only
    if its version is not lower. A column that only one side has is null on the other's rows, and is never filled in."""
    new = new.withColumn("_new", F.lit(1))
    both = new if stored is None else stored.withColumn("_new", F.lit(0)).unionByName(new, allowMissingColumns=True)
    first = ["_new", version] if replace else [version, "_new"]
    w = Window.partitionBy(key).orderBy(*map(F.desc, first), F.desc(F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in both.columns if c != "_new"])))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def search(events: DataFrame, camera: str | None = None, severity: str | None = None, since=None, plate: str | None = None, limit: int = 50, at: str = "at_s") -> DataFrame:
    """Newest events first, at most `limit` (clamped to 1..500). Of a store with days, `since` (seconds) reads only those from it on."""
    if since is not None and "event_date" in events.columns:
        events = events.where(F.col("event_date") >= F.to_date(F.timestamp_seconds(F.lit(since))))
    if camera is not None:
        events = events.where(F.col("camera_id") == camera)
    if severity is not None:
        events = events.where(F.col("severity") == severity.upper())
    if since is not None:
        events = events.where(F.col(at) >= since)
    if plate is not None:
        events = events.where(F.col("plate") == plate)
    return events.orderBy(F.desc(at), F.desc("event_id")).limit(max(1, min(500, limit)))


def summary(events: DataFrame, at: str = "at_s") -> DataFrame:
    """Counts in all, by severity and by camera, and the latest time, in one pass: rows (kind, value, events, latest)."""
    cube = events.groupingSets([[], [F.col("severity")], [F.col("camera_id")]], "severity", "camera_id")
    got = cube.agg(F.count("*").alias("events"), F.max(at).alias("latest"), F.grouping_id("severity", "camera_id").alias("g"))
    kind = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "severity").otherwise("camera")
    return got.select(kind.alias("kind"), F.when(F.col("g") == 1, F.col("severity")).when(F.col("g") == 2, F.col("camera_id")).alias("value"), "events", "latest")


def counts(events: DataFrame, column: str, name: str) -> DataFrame:
    """Occurrences of each value, most frequent first; null is no value."""
    return events.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)


def in_order(rows: DataFrame, keys: list[str], column: str, order: Column, name: str) -> DataFrame:
    """Distinct values of column for each key, in the order of first appearance; only distinct values are gathered."""
    first = rows.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.min(order).alias("_o"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", column))), lambda x: x[column]).alias(name))


def _grouped(events: DataFrame, gap: int, at: str, seq: str) -> DataFrame:
    key = F.struct("plate", F.when(F.col("plate").isNull(), F.col("camera_id")).alias("c"), F.when(F.col("plate").isNull(), F.col("track_id")).alias("t"))
    w = Window.partitionBy("_k").orderBy(at, seq)
    e = events.withColumn("_k", key)
    return e.withColumn("_n", F.when(F.col(at) - F.lag(at).over(w) <= gap, 0).otherwise(1)).withColumn("_i", F.sum("_n").over(w))


def incident_events(events: DataFrame, gap: int = 120, at: str = "at_s", seq: str = "event_id") -> DataFrame:
    """Rows (incident_id, event id): the events of each incident, one a row, however many they are."""
    e = _grouped(events, gap, at, seq)
    w = Window.partitionBy("_k", "_i").orderBy(at, seq)
    return e.select(F.first(seq).over(w).alias("incident_id"), seq)


def newest(incidents: DataFrame, limit: int = 50) -> DataFrame:
    """Incidents that ended last first, at most `limit` (clamped to 1..500)."""
    return incidents.orderBy(F.desc("ended"), F.desc("incident_id")).limit(max(1, min(500, limit)))


def sessions(frames: DataFrame, alerts: DataFrame, outages: DataFrame, states: DataFrame, at: str = "at_s") -> DataFrame:
    """A row for each camera with frames: frames, detections, alerts, seconds, fps, outages, seconds_down and the last link state.

    frames: a row for each detection (camera_id, frame, at); alerts (camera_id); outages as links.outages; states (camera_id, event_id,
    state). Each side is summed to a row a camera before it is joined.
    """
    out = frames.groupBy("camera_id").agg(F.countDistinct("frame").alias("frames"), F.count("*").alias("detections"), (F.max(at) - F.min(at)).cast("long").alias("seconds"))
    out = out.withColumn("fps", F.round(F.col("frames") / F.greatest(F.col("seconds"), F.lit(1)), 1))
    out = out.join(alerts.groupBy("camera_id").agg(F.count("*").alias("alerts")), "camera_id", "left")
    out = out.join(outages.groupBy("camera_id").agg(F.count("*").alias("outages"), F.coalesce(F.sum("seconds"), F.lit(0)).cast("long").alias("seconds_down")), "camera_id", "left")
    out = out.join(states.groupBy("camera_id").agg(F.max_by("state", "event_id").alias("link")), "camera_id", "left")
    return out.fillna(0, ["alerts", "outages", "seconds_down"])


def incidents(events: DataFrame, gap: int = 120, at: str = "at_s", seq: str = "event_id") -> DataFrame:
    """Events grouped into incidents: of one plate, else of one camera and track, none more than `gap` after the one before.

    The peak is the earliest event of the highest score. incident_id is the first event's id. Where events have them: object is the
    first event's label; zones and behaviours (array<struct<name, ...>>) come in order of first appearance.
    """
    e = _grouped(events, gap, at, seq).withColumn("_order", F.struct(at, seq))
    out = e.groupBy("_k", "_i").agg(
        F.min_by(seq, "_order").alias("incident_id"), F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("events"), F.first("plate").alias("plate"),
        F.max_by(F.struct("score", "severity", F.col(seq).alias("id")), F.struct(F.col("score"), -F.col(at), -F.col(seq))).alias("peak"),
    )
    if "label" in events.columns:
        out = out.join(e.groupBy("_k", "_i").agg(F.min_by("label", "_order").alias("object")), ["_k", "_i"])
    out = out.join(in_order(e, ["_k", "_i"], "camera_id", F.col("_order"), "cameras"), ["_k", "_i"], "left").join(in_order(e, ["_k", "_i"], "event_type_name", F.col("_order"), "kinds"), ["_k", "_i"], "left")
    more = ["object"] if "label" in events.columns else []
    if "zone" in events.columns:
        out, more = out.join(in_order(e, ["_k", "_i"], "zone", F.col("_order"), "zones"), ["_k", "_i"], "left"), [*more, "zones"]
    if "behaviours" in events.columns:
        each = e.select("_k", "_i", F.posexplode("behaviours.name").alias("_b", "behaviour"), F.struct(F.col("_order"), F.col("_b")).alias("_order2"))
        out, more = out.join(in_order(each, ["_k", "_i"], "behaviour", F.col("_order2"), "behaviours"), ["_k", "_i"], "left"), [*more, "behaviours"]
    return out.select("incident_id", "started", "ended", "events", "plate", F.col("peak.score").alias("peak_score"), F.col("peak.severity").alias("peak_severity"), F.col("peak.id").alias("peak_event_id"), "cameras", "kinds", *more)
