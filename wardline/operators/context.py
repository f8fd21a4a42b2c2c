"""What a track does: movement measures over its last observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import geometry as G
from wardline.model import DEFAULT, Policy, Zone
from wardline.operators import zones as Z
from wardline.operators.zone_index import ZoneIndex, distance

TRACK = ("camera_id", "track_id")


def segments(obs: DataFrame, policy: Policy = DEFAULT, time: str = "stream_ms", order: str = "k") -> DataFrame:
    """obs with seg: counts up where a track was not seen for longer than forget_s; state never crosses it."""
    w = Window.partitionBy(*TRACK).orderBy(order)
    gap = F.col(time) - F.lag(time).over(w) > policy.forget_s * 1000
    return obs.withColumn("_new", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("seg", F.sum("_new").over(w)).drop("_new")


def context(obs: DataFrame, zones: list[Zone] | ZoneIndex, policy: Policy = DEFAULT, matrix: tuple[float, ...] | None = None, order: str = "k", time: str = "stream_ms") -> DataFrame:
    """Located observations with the track's measures; the first and last of up to `history` points count.

    Needs nx, ny (ground point) and hr (box height), all normalised, and label. Adds seg, zone, samples, age_s, speed,
    heading, dwell_s, variance, growth, target, target_d, approaching, moving, near_camera, streak; speed_mps and target_m are
    null without a calibration matrix. One shuffle by track serves all windows, and two sorts: by track, to find segments, and by segment. A short list of zones unrolls into the plan; an index
    of them, for large fleets, is joined once.
    """
    indexed = isinstance(zones, ZoneIndex)
    # of an index, rows carry their nearest zone's name through the sorts; its edges are looked up behind them
    df = segments(zones.place(obs, nearest="_t") if indexed else Z.locate(obs, zones), policy, time, order)
    df = df if indexed else Z.distances(df, zones, policy, "_ds")
    key = [*TRACK, "seg"]
    w = Window.partitionBy(*key).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    point = F.struct(F.col("nx").alias("x"), F.col("ny").alias("y"), F.col("hr").alias("h"), F.col(time).alias("t"), *([] if indexed else [F.col("_ds").alias("ds")]))
    # the oldest of the points that count: as far back as the history goes, or else the first one
    df = df.withColumns({
        "_n": F.row_number().over(w), "_p": F.lag(F.struct("nx", "ny", "zone")).over(w), "_0": F.coalesce(F.lag(point, policy.history - 1).over(w), F.first(point).over(upto)),
    })
    df = df.withColumns({"dx": F.col("nx") - F.col("_p.nx"), "dy": F.col("ny") - F.col("_p.ny"), "_stays": F.col("_p").isNotNull() & F.col("zone").eqNullSafe(F.col("_p.zone"))})
    step = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    df = df.withColumn("step", F.when(step >= policy.min_step, step))
    steps = w.rowsBetween(-(policy.history - 2), 0)
    df = df.withColumns({
        **{f"s{c}": F.sum(F.col(f"d{c}") / F.col("step")).over(steps) for c in ("x", "y")}, "sn": F.count("step").over(steps),
        "stay": F.sum(F.when(F.col("_stays"), 0).otherwise(1)).over(upto), "_since": F.last(F.when(~F.col("_stays"), F.struct(F.col(time).alias("t"))), ignorenulls=True).over(upto),
    })
    mean = F.sqrt(F.pow(F.col("sx") / F.col("sn"), 2) + F.pow(F.col("sy") / F.col("sn"), 2))
    df = df.withColumns({
        "samples": F.least(F.col("_n"), F.lit(policy.history)).cast("long"), "fx0": F.col("_0.x"), "fy0": F.col("_0.y"), "fh0": F.col("_0.h"), "ft0": F.col("_0.t"),
        "variance": F.when(F.col("sn") < 2, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - mean))),
    })
    age = (F.col(time) - F.col("ft0")) / 1000
    df = df.withColumn("age_s", F.greatest(age, F.lit(0.0)))
    mx, my = F.col("nx") - F.col("fx0"), F.col("ny") - F.col("fy0")
    fine = (F.col("samples") >= 2) & (F.col("age_s") > 0)
    df = df.withColumn("speed", F.when(fine, F.sqrt(mx * mx + my * my) / F.col("age_s")).otherwise(F.lit(0.0)))
    df = df.withColumns({
        "heading": F.when(F.col("speed") < policy.still_speed, "-").otherwise(G.compass(mx, my)),
        "growth": F.when(fine, (F.col("hr") - F.col("fh0")) / F.col("age_s")).otherwise(F.lit(0.0)),
    })
    if indexed:
        df = zones.outlined(df.withColumns({"target": F.col("_t.zone"), "target_d": F.col("_t.d")}), "_t", "_edges")
        was = distance(F.col("fx0"), F.col("fy0"), F.col("_edges"))
    else:  # the oldest point's own distance from the zone that is now the nearest
        place, name, d = Z.nearest_of(F.col("_ds"), zones, policy, F.col("camera_id"))
        df = df.withColumns({"target": name, "target_d": d})
        was = F.get(F.col("_0.ds"), place - 1)
        df = df.withColumn("_t", Z.nearest_armed(F.col("nx"), F.col("ny"), zones, policy, F.col("camera_id"))) if matrix else df
    df = df.withColumn("approaching", F.coalesce((F.col("samples") >= 2) & (was - F.col("target_d") > policy.approach_epsilon), F.lit(False)))
    if matrix:
        (ax, ay), (bx, by) = G.project(F.col("fx0"), F.col("fy0"), matrix), G.project(F.col("nx"), F.col("ny"), matrix)
        px, py = G.project(F.col("_t.x"), F.col("_t.y"), matrix)
        df = df.withColumns({"speed_mps": F.when(fine, G.distance(ax, ay, bx, by) / F.col("age_s")).otherwise(F.lit(0.0)), "target_m": G.distance(bx, by, px, py)})
    else:
        df = df.withColumns({"speed_mps": F.lit(None).cast("double"), "target_m": F.lit(None).cast("double")})
    moving = F.when(F.col("speed_mps").isNotNull(), F.col("speed_mps") >= policy.still_speed_mps).otherwise(F.col("speed") >= policy.still_speed)
    df = df.withColumns({"moving": moving, "near_camera": F.col("hr") >= policy.near_ratio})
    df = df.withColumn("dwell_s", F.when(F.col("zone").isNull(), 0.0).otherwise((F.col(time) - F.col("_since.t")) / 1000))
    df = df.withColumn("_on", F.coalesce(F.col("approaching") & F.col("moving"), F.lit(False)))
    off = F.last(F.when(~F.col("_on"), F.col("_n")), ignorenulls=True).over(upto)
    df = df.withColumn("streak", F.when(F.col("_on"), F.col("_n") - F.coalesce(off, F.lit(0))).otherwise(0).cast("long"))
    return df.drop("dx", "dy", "step", "sx", "sy", "sn", "fx0", "fy0", "fh0", "ft0", "_t", "_on", "_n", "_p", "_0", "_stays", "_since", "_ds", "_edges")


def speed_label(policy_unit: str = "m") -> Column:
    return F.when(F.col("speed_mps").isNotNull(), F.format_string(f"%.2f {policy_unit}/s", "speed_mps")).otherwise(F.format_string("%.2f w/s", "speed"))


def distance_label(unit: str = "m") -> Column:
    """How far the target is, in the camera's unit where it is calibrated, else in widths; null without a target."""
    metres = F.when(F.col("target_m").isNotNull(), F.format_string(f"%.1f {unit}", "target_m"))
    return F.coalesce(metres, F.when(F.col("target_d").isNotNull(), F.format_string("%.2f w", "target_d")))
