"""Named behaviours of a track and the explainable score built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.model import DEFAULT, Policy
from wardline.operators import zones as Z
from wardline.operators.context import TRACK

FACTOR = "struct<name:string,points:int,detail:string>"


def night(ts: Column, policy: Policy = DEFAULT, forced: Column | None = None) -> Column:
    """Whether it is night; what `forced` says, where it is not null, goes before the clock."""
    clock = (F.hour(ts) >= policy.night_from) | (F.hour(ts) < policy.night_to)
    return clock if forced is None else F.coalesce(forced, clock)


def time_of_day(is_night: Column) -> Column:
    return F.when(is_night, "NIGHT").otherwise("DAY")


def _named(on: Column, name: str, points, detail: Column) -> Column:
    """An array of the factor where it holds, else an empty one. Arrays are concatenated, not filtered: a filter is interpreted row by row."""
    points = points if isinstance(points, Column) else F.lit(points)
    factor = F.struct(F.lit(name).alias("name"), points.cast("int").alias("points"), detail.alias("detail"))
    return F.when(on, F.array(factor)).otherwise(F.array().cast(f"array<{FACTOR}>"))


def behaviours(ctx: DataFrame, policy: Policy = DEFAULT, ts: str = "ts") -> DataFrame:
    """Context rows with night and behaviours array<struct<name, points, detail>>, in a fixed order."""
    p, c = policy, F.col
    person = Z.category(c("label")) == "PERSON"
    loiter = F.least(F.lit(p.loiter_cap), F.bround((c("dwell_s") - p.loiter_after) * p.loiter_per_s, 0).cast("int"))
    tamper = person & (c("hr") >= p.tamper_ratio)
    limit = F.when(person, p.fast_person_mps).otherwise(p.fast_vehicle_mps)
    found = [
        _named(c("zone").isNotNull() & (c("dwell_s") > p.loiter_after) & (loiter > 0), "LOITERING", loiter, F.format_string("%.0fs continuously inside %s", "dwell_s", "zone")),
        _named(c("streak") >= p.approach_rows, "BORDER-FACING MOVEMENT", p.approach_points, F.format_string("closing on %s heading %s for %d frames", "target", "heading", "streak")),
        _named((c("samples") >= p.erratic_samples) & c("moving") & (c("variance") >= p.erratic_variance), "ERRATIC MOVEMENT", p.erratic_points, F.format_string("inconsistent heading (variance %.2f)", "variance")),
        _named(c("night") & c("moving"), "NIGHT MOVEMENT", p.night_move_points, F.lit("moving during the night window")),
        _named(F.coalesce(c("speed_mps") >= limit, F.lit(False)), "RAPID MOVEMENT", p.fast_points, F.format_string("moving at %.2f m/s", "speed_mps")),
        _named(tamper, "CAMERA TAMPERING", p.tamper_points, F.format_string("person fills %.0f%% of frame height", c("hr") * 100)),
        _named(person & ~tamper & (c("hr") >= p.camera_ratio) & (c("growth") >= p.camera_growth), "APPROACHING CAMERA", p.camera_points, F.format_string("apparent size growing %.0f%%/s", c("growth") * 100)),
    ]
    df = ctx.withColumn("night", night(c(ts), p))
    return df.withColumn("behaviours", F.concat(*found))


def with_findings(rows: DataFrame, findings: DataFrame, order: str = "k", by: tuple[str, ...] = TRACK) -> DataFrame:
    """rows of behaviours() with what other checks found about their track after the movement behaviours.

    findings: rows (camera_id, track_id, from_k, nth, name, points, detail), of one track a few (a registry check, an identity). Each
    counts from the track's row from_k on, in order of nth; those without a name or points count nowhere.

    by: what tells tracks apart. Rows dealt out by exactly these columns stay where they are, unsorted; a partition's findings are held
    in memory, so deal rows out by their number.
    """
    f = findings.where("name is not null and points <> 0")
    f = f.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("nth", "from_k", "name", "points", "detail"))).alias("_found"))
    out = rows.join(f.hint("shuffle_hash"), list(by), "left")
    here = F.filter(F.coalesce("_found", F.array().cast(f.schema["_found"].dataType)), lambda x: x["from_k"] <= F.col(order))
    more = F.transform(here, lambda x: F.struct(x["name"].alias("name"), x["points"].cast("int").alias("points"), x["detail"].alias("detail")))
    return out.withColumn("behaviours", F.concat("behaviours", more)).drop("_found")


def severity(score: Column, policy: Policy = DEFAULT) -> Column:
    top, high, medium = policy.severity
    return F.when(score >= top, "CRITICAL").when(score >= high, "HIGH").when(score >= medium, "MEDIUM").otherwise("LOW")


def severity_rank(name: Column) -> Column:
    return F.when(name == "CRITICAL", 3).when(name == "HIGH", 2).when(name == "MEDIUM", 1).otherwise(0)


def risk(rows: DataFrame, policy: Policy = DEFAULT, confidence: str = "confidence") -> DataFrame:
    """Rows with factors, score, severity and reason; the score is the clamped sum of the factors' points."""
    p, c = policy, F.col
    zone = F.struct(
        F.when(c("zone").isNull(), "CAMERA INTEGRITY").otherwise(F.concat("zone_kind", F.lit(" ZONE"))).alias("name"),
        F.when(c("zone").isNull(), p.zoneless_base).otherwise(F.bround(c("base_risk") * Z.weight(c("label")), 0)).cast("int").alias("points"),
        F.when(c("zone").isNull(), "outside any zone").otherwise(F.concat(F.lit("presence inside "), c("zone"))).alias("detail"),
    )
    sure = F.greatest(F.lit(-p.confidence_cap), F.least(F.lit(p.confidence_cap), F.bround((c(confidence) - p.pivot) * p.gain, 0))).cast("int")
    extra = [
        _named(sure != 0, "DETECTION CONFIDENCE", sure, F.format_string("model confidence %.0f%%", c(confidence) * 100)),
        _named(c("night"), "NIGHT-TIME", p.night_bonus, F.lit("night window")),
    ]
    df = rows.withColumn("factors", F.concat(F.array(zone), *extra, "behaviours"))
    df = df.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), F.aggregate("factors", F.lit(0), lambda a, x: a + x["points"]))))
    up = F.transform(F.filter(F.slice("factors", 2, 100), lambda x: x["points"] > 0), lambda x: F.lower(x["name"]))
    base = F.when(c("zone").isNull(), "Camera integrity threat detected").otherwise(F.concat(F.initcap("zone_kind"), F.lit("-zone entry detected")))
    reason = (
        F.when(F.size(up) == 0, F.concat(base, F.lit(".")))
        .when(F.size(up) == 1, F.concat(base, F.lit(", aggravated by "), F.get(up, 0), F.lit(".")))
        .otherwise(F.concat(base, F.lit(". Multiple contextual signals ("), F.array_join(up, ", "), F.lit(") indicate suspicious activity.")))
    )
    return df.withColumns({"severity": severity(c("score"), p), "reason": reason})
