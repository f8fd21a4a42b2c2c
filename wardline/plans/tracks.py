"""Queries over located and moving objects: zones, context, behaviour, risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import geometry as G
from wardline.model import Zone
from wardline.operators import context as C
from wardline.operators import risk as R
from wardline.operators import zones as Z
from wardline.operators.zone_index import ZoneIndex, zone_table
from wardline.plans.fixtures import ctes, view

ZONES = [
    Zone("RESTRICTED", "RESTRICTED", 60, ((0.55, 0.50), (1.0, 0.50), (1.0, 1.0), (0.55, 1.0))),
    Zone("WATCH", "WATCH", 30, ((0.30, 0.50), (0.60, 0.50), (0.60, 1.0), (0.30, 1.0))),
    Zone("PATROL-L", "PATROL", 20, ((0.05, 0.55), (0.25, 0.55), (0.25, 0.75), (0.15, 0.75), (0.15, 0.95), (0.05, 0.95)), ("PERSON",)),
]
#: Image and world points of the calibrated camera.
CALIBRATION = (((0.10, 0.56), (0.0, 40.0)), ((0.95, 0.56), (12.0, 40.0)), ((1.00, 0.99), (12.0, 6.0)), ((0.05, 0.99), (0.0, 6.0)))
MATRIX = G.homography(CALIBRATION)


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_obs with normalised ground point and height."""
    o = view(spark, sf_dir, "fx_obs")
    return o.withColumns({"nx": G.normalize(F.col("fx"), 960), "ny": G.normalize(F.col("fy"), 540), "hr": G.normalize(F.col("bh"), 540), "confidence": F.col("conf_pct") / 100})


def contexts(spark, sf_dir, matrix=None) -> DataFrame:
    return C.context(observations(spark, sf_dir), ZONES, matrix=matrix)


def scored(spark, sf_dir) -> DataFrame:
    return R.risk(R.behaviours(contexts(spark, sf_dir)))


def zone_locate(spark, sf_dir):
    o = Z.locate(observations(spark, sf_dir), ZONES)
    return o.select("event_id", "camera_id", G.track_label(F.col("track_id")).alias("track"), "zone", "zone_kind", "base_risk", G.denormalize(F.col("nx"), 960).cast("long").alias("px"))


def zone_nearest(spark, sf_dir):
    o = observations(spark, sf_dir).withColumn("t", Z.nearest_armed(F.col("nx"), F.col("ny"), ZONES))
    return o.select("event_id", F.col("t.zone").alias("target"), r6(F.col("t.d")).alias("distance"))


def class_weight(spark, sf_dir):
    o = observations(spark, sf_dir).where(F.col("label").isin(Z.resolve_labels(["person", "vehicle"])))
    o = o.groupBy("label").agg(F.count("*").alias("n"))
    return o.select("label", Z.category(F.col("label")).alias("category"), Z.weight(F.col("label")).alias("weight"), "n")


def boxed(df):
    half = F.floor(F.col("bh") / 4)
    return df.withColumns({"x1": F.col("fx") - half, "y1": F.col("fy") - F.col("bh"), "x2": F.col("fx") + half, "y2": F.col("fy")})


def iou_edges(spark, sf_dir):
    """Boxes of consecutive frames of a camera that overlap by 0.3 or more."""
    o = boxed(observations(spark, sf_dir)).withColumn("frame", F.floor(F.col("event_id") / 8)).select("camera_id", "frame", "event_id", "x1", "y1", "x2", "y2")
    a, b = o.alias("a"), o.withColumn("frame", F.col("frame") - 1).alias("b")
    box = lambda t: [F.col(f"{t}.{c}") for c in ("x1", "y1", "x2", "y2")]
    j = a.join(b, ["camera_id", "frame"]).withColumn("iou", G.iou(box("a"), box("b"))).where("iou >= 0.3")
    return j.select("camera_id", "frame", F.col("a.event_id").alias("first_event"), F.col("b.event_id").alias("next_event"), r6(F.col("iou")).alias("iou"))


def region_boxes(spark, sf_dir):
    o = boxed(observations(spark, sf_dir))
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    out = {"event_id": F.col("event_id"), "area": G.area(*box)}
    for name, part in (("torso", G.torso(*box)), ("body", G.body(*box)), ("plate", G.plate_search(*box))):
        out |= {f"{name}_{k}": v.cast("long") for k, v in zip(("x1", "y1", "x2", "y2"), part, strict=True)}
    cx, cy = G.centroid(*box)
    return o.select(*[v.alias(k) for k, v in out.items()], cx.alias("cx"), cy.alias("cy"))


def track_context(spark, sf_dir):
    c = contexts(spark, sf_dir)
    return c.select("event_id", "seg", "samples", r6(F.col("speed")).alias("speed"), "heading", r6(F.col("growth")).alias("growth"), "approaching", "moving", "near_camera", r6(F.col("hr")).alias("height_ratio"))


def metric_speed(spark, sf_dir):
    c = contexts(spark, sf_dir, MATRIX)
    return c.select("event_id", r6(F.col("speed_mps")).alias("speed_mps"), r6(F.col("target_m")).alias("target_m"), "moving")


def dwell(spark, sf_dir):
    return contexts(spark, sf_dir).select("event_id", "zone", r6(F.col("dwell_s")).alias("dwell_s"))


def heading_variance(spark, sf_dir):
    return contexts(spark, sf_dir).select("event_id", r6(F.col("variance")).alias("variance"))


def approach_streak(spark, sf_dir):
    return contexts(spark, sf_dir).select("event_id", F.col("streak").cast("long").alias("streak"))


def behaviours(spark, sf_dir):
    b = R.behaviours(contexts(spark, sf_dir)).select("event_id", F.explode("behaviours").alias("b"))
    return b.select("event_id", F.col("b.name").alias("behaviour"), F.col("b.points").alias("points"))


def risk_score(spark, sf_dir):
    s = scored(spark, sf_dir)
    return s.select("event_id", "score", "severity", F.size("factors").alias("n_factors"), "reason")


def severity_by_zone(spark, sf_dir):
    """At-risk observations by zone and severity: the flagship query."""
    s = scored(spark, sf_dir).where("zone is not null").groupBy("zone", "severity")
    return s.agg(F.count("*").alias("observations"), F.countDistinct("track_id").alias("tracks"), F.max("score").alias("peak_score"))


def _index(spark, grid=8):
    return ZoneIndex.build(zone_table(spark, ZONES), grid)


def zone_locate_indexed(spark, sf_dir):
    """The same zones as a joined table of cells."""
    o = _index(spark).place(observations(spark, sf_dir))
    return o.select("event_id", "camera_id", G.track_label(F.col("track_id")).alias("track"), "zone", "zone_kind", "base_risk", G.denormalize(F.col("nx"), 960).cast("long").alias("px"))


def zone_nearest_indexed(spark, sf_dir):
    o = _index(spark, 16).place(observations(spark, sf_dir))
    return o.select("event_id", F.col("nearest.zone").alias("target"), r6(F.col("nearest.d")).alias("distance"))


def severity_by_zone_indexed(spark, sf_dir):
    """The whole chain to risk over indexed zones."""
    s = R.risk(R.behaviours(C.context(observations(spark, sf_dir), _index(spark)))).where("zone is not null").groupBy("zone", "severity")
    return s.agg(F.count("*").alias("observations"), F.countDistinct("track_id").alias("tracks"), F.max("score").alias("peak_score"))


QUERIES = {f.__name__: f for f in (zone_locate_indexed, zone_nearest_indexed, severity_by_zone_indexed, zone_locate, zone_nearest, class_weight, iou_edges, region_boxes, track_context, metric_speed, dwell, heading_variance, approach_streak, behaviours, risk_score, severity_by_zone)}

O = """o AS (SELECT *, fx / 960.0 AS nx, fy / 540.0 AS ny, bh / 540.0 AS hr, conf_pct / 100.0::DOUBLE AS confidence, CASE WHEN label = 'PERSON' THEN 'PERSON' ELSE 'VEHICLE' END AS category FROM fx_obs)"""
PIP = """pz AS (SELECT event_id, zone_name, (max(CASE WHEN abs((x2-x1)*(ny-y1)-(y2-y1)*(nx-x1)) <= 1e-9 AND nx BETWEEN least(x1,x2)-1e-9 AND greatest(x1,x2)+1e-9 AND ny BETWEEN least(y1,y2)-1e-9 AND greatest(y1,y2)+1e-9 THEN 1 ELSE 0 END) = 1
    OR sum(CASE WHEN (y1 > ny) <> (y2 > ny) AND nx < x1 + (ny-y1)/(y2-y1)*(x2-x1) THEN 1 ELSE 0 END) % 2 = 1) AS inside,
  arg_min(struct_pack(px := x1 + t*(x2-x1), py := y1 + t*(y2-y1)), (sqrt(pow(nx-(x1+t*(x2-x1)),2)+pow(ny-(y1+t*(y2-y1)),2)), i)) AS near,
  min(sqrt(pow(nx-(x1+t*(x2-x1)),2)+pow(ny-(y1+t*(y2-y1)),2))) AS d, any_value(nx) AS nx, any_value(ny) AS ny
  FROM (SELECT o.event_id, nx, ny, fx_edge.*, greatest(0, least(1, ((nx-x1)*(x2-x1)+(ny-y1)*(y2-y1))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))) AS t FROM o, fx_edge) GROUP BY event_id, zone_name),
td AS (SELECT event_id, CASE WHEN inside THEN 0.0 ELSE d END AS d, CASE WHEN inside THEN nx ELSE near.px END AS px, CASE WHEN inside THEN ny ELSE near.py END AS py FROM pz WHERE zone_name = 'RESTRICTED')"""
LOC = """loc AS (SELECT o.*, CASE WHEN contains(z.objects, category) THEN z.zone_name END AS zone, CASE WHEN contains(z.objects, category) THEN z.kind END AS zone_kind, CASE WHEN contains(z.objects, category) THEN z.base_risk END AS base_risk
  FROM o LEFT JOIN (SELECT event_id, arg_max(zone_name, priority * 1000 + base_risk) AS zn FROM pz JOIN fx_zone USING (zone_name) WHERE inside GROUP BY 1) b USING (event_id) LEFT JOIN fx_zone z ON zn = z.zone_name)"""
CTX = """sg AS (SELECT *, sum(new) OVER (PARTITION BY camera_id, track_id ORDER BY k) AS seg FROM (SELECT *, CASE WHEN stream_ms - lag(stream_ms) OVER (PARTITION BY camera_id, track_id ORDER BY k) > 60000 THEN 1 ELSE 0 END AS new FROM loc)),
st AS (SELECT *, nx - lag(nx) OVER w AS dx, ny - lag(ny) OVER w AS dy, lag(zone) OVER w AS pzone, lag(k) OVER w AS pk FROM sg WINDOW w AS (PARTITION BY camera_id, track_id, seg ORDER BY k)),
s2 AS (SELECT *, CASE WHEN sqrt(dx*dx+dy*dy) >= 1e-4 THEN sqrt(dx*dx+dy*dy) END AS step, CASE WHEN zone IS NOT DISTINCT FROM pzone AND pk IS NOT NULL THEN 0 ELSE 1 END AS moved FROM st),
s3 AS (SELECT *, count(*) OVER h AS samples, first_value(event_id) OVER h AS e0, first_value(nx) OVER h AS x0, first_value(ny) OVER h AS y0, first_value(hr) OVER h AS h0, first_value(stream_ms) OVER h AS t0,
  count(step) OVER g AS sn, sum(dx/step) OVER g AS sx, sum(dy/step) OVER g AS sy, sum(moved) OVER (PARTITION BY camera_id, track_id, seg ORDER BY k) AS stay
  FROM s2 WINDOW h AS (PARTITION BY camera_id, track_id, seg ORDER BY k ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), g AS (PARTITION BY camera_id, track_id, seg ORDER BY k ROWS BETWEEN 22 PRECEDING AND CURRENT ROW)),
s4 AS (SELECT s3.*, (stream_ms - t0) / 1000.0::DOUBLE AS age_s, CASE WHEN sn < 2 THEN 0.0 ELSE greatest(0, least(1, 1 - sqrt(pow(sx/sn,2)+pow(sy/sn,2)))) END AS variance, t.d AS target_d, t.px, t.py, f.d AS was_d,
  CASE WHEN zone IS NULL THEN 0.0 ELSE (stream_ms - first_value(stream_ms) OVER (PARTITION BY camera_id, track_id, seg, stay ORDER BY k)) / 1000.0::DOUBLE END AS dwell_s FROM s3 JOIN td t USING (event_id) JOIN td f ON f.event_id = e0),
s5 AS (SELECT *, CASE WHEN samples >= 2 AND age_s > 0 THEN sqrt((nx-x0)*(nx-x0)+(ny-y0)*(ny-y0))/age_s ELSE 0.0 END AS speed, CASE WHEN samples >= 2 AND age_s > 0 THEN (hr-h0)/age_s ELSE 0.0 END AS growth, samples >= 2 AND was_d - target_d > 0.01 AS approaching FROM s4),
s6 AS (SELECT *, speed >= 0.01 AS moving, CASE WHEN speed < 0.01 THEN '-' ELSE (['E','NE','N','NW','W','SW','S','SE'])[CAST(floor(fmod(fmod(degrees(atan2(-(ny-y0), nx-x0)) + 360.0, 360.0) + 22.5, 360.0) / 45) AS INT) + 1] END AS heading FROM s5),
s7 AS (SELECT *, approaching AND moving AS onn, sum(CASE WHEN approaching AND moving THEN 0 ELSE 1 END) OVER (PARTITION BY camera_id, track_id, seg ORDER BY k) AS off FROM s6),
ctx AS (SELECT *, CASE WHEN onn THEN sum(CASE WHEN onn THEN 1 ELSE 0 END) OVER (PARTITION BY camera_id, track_id, seg, off ORDER BY k) ELSE 0 END AS streak, hour(ts) >= 18 OR hour(ts) < 6 AS night FROM s7)"""
BEH = """bh0 AS (SELECT *, CASE WHEN zone IS NOT NULL AND dwell_s > 5 THEN least(20, CAST(round_even((dwell_s - 5) * 1.5::DOUBLE, 0) AS INT)) ELSE 0 END AS b1, CASE WHEN streak >= 5 THEN 8 ELSE 0 END AS b2,
  CASE WHEN samples >= 8 AND moving AND variance >= 0.45::DOUBLE THEN 6 ELSE 0 END AS b3, CASE WHEN night AND moving THEN 4 ELSE 0 END AS b4, CASE WHEN category = 'PERSON' AND hr >= 0.65::DOUBLE THEN 30 ELSE 0 END AS b5,
  CASE WHEN category = 'PERSON' AND hr < 0.65::DOUBLE AND hr >= 0.35::DOUBLE AND growth >= 0.06::DOUBLE THEN 10 ELSE 0 END AS b6 FROM ctx),
beh AS (SELECT *, list_filter([struct_pack(o := 1, name := 'LOITERING', p := b1), struct_pack(o := 2, name := 'BORDER-FACING MOVEMENT', p := b2), struct_pack(o := 3, name := 'ERRATIC MOVEMENT', p := b3), struct_pack(o := 4, name := 'NIGHT MOVEMENT', p := b4),
  struct_pack(o := 5, name := 'CAMERA TAMPERING', p := b5), struct_pack(o := 6, name := 'APPROACHING CAMERA', p := b6)], lambda x: x.p > 0) AS bs FROM bh0)"""
RISK = """rk0 AS (SELECT *, CAST(CASE WHEN zone IS NULL THEN 45 ELSE round_even(base_risk * CASE label WHEN 'CAR' THEN 1.1::DOUBLE WHEN 'TRUCK' THEN 1.2::DOUBLE WHEN 'BUS' THEN 1.2::DOUBLE WHEN 'BICYCLE' THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END, 0) END AS INT) AS zp,
  CAST(greatest(-10, least(10, round_even((confidence - 0.6::DOUBLE) * 50, 0))) AS INT) AS cp FROM beh),
rk1 AS (SELECT *, CASE WHEN cp > 0 THEN ['detection confidence'] ELSE [] END || CASE WHEN night THEN ['night-time'] ELSE [] END || list_transform(list_filter(bs, lambda x: x.p > 0), lambda x: lower(x.name)) AS up,
  1 + CASE WHEN cp <> 0 THEN 1 ELSE 0 END + CASE WHEN night THEN 1 ELSE 0 END + len(bs) AS n_factors, greatest(0, least(100, zp + cp + CASE WHEN night THEN 6 ELSE 0 END + CAST(coalesce(list_sum(list_transform(bs, lambda x: x.p)), 0) AS INT))) AS score FROM rk0),
rk AS (SELECT *, CASE WHEN score >= 90 THEN 'CRITICAL' WHEN score >= 65 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN zone IS NULL THEN 'Camera integrity threat detected' ELSE upper(zone_kind[1]) || lower(zone_kind[2:]) || '-zone entry detected' END || CASE len(up) WHEN 0 THEN '.' WHEN 1 THEN ', aggravated by ' || up[1] || '.'
    ELSE '. Multiple contextual signals (' || array_to_string(up, ', ') || ') indicate suspicious activity.' END AS reason FROM rk1)"""


def sql(select: str, *layers: str) -> str:
    """select over the derived views and the given layers of CTEs."""
    text = ",\n".join(layers)
    return f"WITH {ctes(text + select)}{',' if ctes(text + select) and text else ''}\n{text}\n{select}"


TO_CTX = (O, PIP, LOC, CTX)
_m = MATRIX
_w = lambda x, y: f"({_m[6]!r}::DOUBLE*{x}+{_m[7]!r}::DOUBLE*{y}+1.0)"
_px = lambda x, y: f"(({_m[0]!r}::DOUBLE*{x}+{_m[1]!r}::DOUBLE*{y}+{_m[2]!r}::DOUBLE)/{_w(x, y)})"
_py = lambda x, y: f"(({_m[3]!r}::DOUBLE*{x}+{_m[4]!r}::DOUBLE*{y}+{_m[5]!r}::DOUBLE)/{_w(x, y)})"
_dist = lambda a, b, c, d: f"sqrt(pow({_px(a, b)}-{_px(c, d)},2)+pow({_py(a, b)}-{_py(c, d)},2))"
_B = "b AS (SELECT *, fx - floor(bh / 4) AS x1, fy - bh AS y1, fx + floor(bh / 4) AS x2, fy AS y2, CAST(floor(event_id / 8) AS BIGINT) AS frame FROM fx_obs)"
ORACLE = {
    "zone_locate": sql("SELECT event_id, camera_id, format('P{:03d}', track_id) AS track, zone, zone_kind, base_risk, CAST(round_even(nx * 960, 0) AS BIGINT) AS px FROM loc", O, PIP, LOC),
    "zone_nearest": sql("SELECT event_id, 'RESTRICTED' AS target, round(d, 6) + 0.0 AS distance FROM td", O, PIP),
    "class_weight": sql("SELECT label, CASE WHEN label = 'PERSON' THEN 'PERSON' ELSE 'VEHICLE' END AS category, CAST(CASE label WHEN 'CAR' THEN 1.1 WHEN 'TRUCK' THEN 1.2 ELSE 1.0 END AS DOUBLE) AS weight, count(*) AS n FROM fx_obs GROUP BY 1"),
    "iou_edges": sql("""SELECT camera_id, frame, e1 AS first_event, e2 AS next_event, round(iou, 6) + 0.0 AS iou FROM (SELECT a.camera_id, a.frame, a.event_id AS e1, c.event_id AS e2,
  CASE WHEN least(a.x2,c.x2) > greatest(a.x1,c.x1) AND least(a.y2,c.y2) > greatest(a.y1,c.y1) THEN (least(a.x2,c.x2)-greatest(a.x1,c.x1))*(least(a.y2,c.y2)-greatest(a.y1,c.y1)) /
   ((a.x2-a.x1)*(a.y2-a.y1)+(c.x2-c.x1)*(c.y2-c.y1)-(least(a.x2,c.x2)-greatest(a.x1,c.x1))*(least(a.y2,c.y2)-greatest(a.y1,c.y1))) ELSE 0.0 END AS iou FROM b a JOIN b c ON a.camera_id = c.camera_id AND c.frame = a.frame + 1) WHERE iou >= 0.3""", _B),
    "region_boxes": sql("""SELECT event_id, CAST((x2-x1)*(y2-y1) AS BIGINT) AS area, CAST(x1 + trunc((x2-x1)*0.2::DOUBLE) AS BIGINT) AS torso_x1, CAST(y1 + trunc((y2-y1)*0.15::DOUBLE) AS BIGINT) AS torso_y1, CAST(x2 - trunc((x2-x1)*0.2::DOUBLE) AS BIGINT) AS torso_x2, CAST(y1 + trunc((y2-y1)*0.55::DOUBLE) AS BIGINT) AS torso_y2,
  CAST(x1 + trunc((x2-x1)*0.15::DOUBLE) AS BIGINT) AS body_x1, CAST(y1 + trunc((y2-y1)*0.35::DOUBLE) AS BIGINT) AS body_y1, CAST(x2 - trunc((x2-x1)*0.15::DOUBLE) AS BIGINT) AS body_x2, CAST(y2 - trunc((y2-y1)*0.1::DOUBLE) AS BIGINT) AS body_y2,
  CAST(x1 AS BIGINT) AS plate_x1, CAST(y1 + trunc((y2-y1)*0.4::DOUBLE) AS BIGINT) AS plate_y1, CAST(x2 AS BIGINT) AS plate_x2, CAST(y2 AS BIGINT) AS plate_y2, CAST(floor((x1+x2)/2) AS BIGINT) AS cx, CAST(floor((y1+y2)/2) AS BIGINT) AS cy FROM b""", _B),
    "track_context": sql("SELECT event_id, CAST(seg AS BIGINT) AS seg, samples, round(speed, 6) + 0.0 AS speed, heading, round(growth, 6) + 0.0 AS growth, approaching, moving, hr >= 0.55 AS near_camera, round(hr, 6) + 0.0 AS height_ratio FROM ctx", *TO_CTX),
    "metric_speed": sql(f"SELECT event_id, round(v, 6) + 0.0 AS speed_mps, round(tm, 6) + 0.0 AS target_m, v >= 0.25 AS moving FROM (SELECT event_id, CASE WHEN samples >= 2 AND age_s > 0 THEN {_dist('x0', 'y0', 'nx', 'ny')} / age_s ELSE 0.0 END AS v, {_dist('px', 'py', 'nx', 'ny')} AS tm FROM ctx)", *TO_CTX),
    "dwell": sql("SELECT event_id, zone, round(dwell_s, 6) + 0.0 AS dwell_s FROM ctx", *TO_CTX),
    "heading_variance": sql("SELECT event_id, round(variance, 6) + 0.0 AS variance FROM ctx", *TO_CTX),
    "approach_streak": sql("SELECT event_id, CAST(streak AS BIGINT) AS streak FROM ctx", *TO_CTX),
    "behaviours": sql("SELECT event_id, x.name AS behaviour, x.p AS points FROM (SELECT event_id, unnest(bs) AS x FROM beh)", *TO_CTX, BEH),
    "risk_score": sql("SELECT event_id, score, severity, CAST(n_factors AS INT) AS n_factors, reason FROM rk", *TO_CTX, BEH, RISK),
    "severity_by_zone": sql("SELECT zone, severity, count(*) AS observations, count(DISTINCT track_id) AS tracks, max(score) AS peak_score FROM rk WHERE zone IS NOT NULL GROUP BY 1, 2", *TO_CTX, BEH, RISK),
}
ORACLE |= {f"{q}_indexed": ORACLE[q] for q in ("zone_locate", "zone_nearest", "severity_by_zone")}
