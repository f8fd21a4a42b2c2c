"""Configuration and reference data as DataFrames. Schemas are declared, never inferred."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.geometry import homography
from wardline.model import DETECTIONS, Policy, Zone
from wardline.operators.plates import clean_registry

ZONE_FILE = "camera_id string, calibration struct<unit:string,points:array<struct<image:array<double>,world:array<double>>>>, zones array<struct<name:string,kind:string,base_risk:int,description:string,objects:array<string>,polygon:array<array<double>>>>"
#: Cameras and areas are kept as the text of their objects, for their fields vary.
FLEET_FILE = "cameras array<string>, base map<string,string>, geofences array<struct<name:string,kind:string,description:string,polygon:array<array<double>>,points:array<array<double>>>>"
REGISTRY_FILE = "vehicles array<struct<plate:string,vehicle_class:string,make:string,model:string,colour:string,status:string,note:string>>"
ROSTER_FILE = "people array<struct<id:string,label:string,role:string,vectors:array<array<float>>>>"
ANNOTATION = "filename string, object array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"
PLACE = ("lat", "latitude", "lon", "longitude", "bearing", "heading", "fov", "field_of_view", "height_m", "height", "site")
#: What a camera may set: its address and place, how it is read, and every threshold of a policy.
SETTINGS = ("camera_id", "source", "zones", "zones_path", "name", "stride", "limit", "confidence", "labels", *PLACE, *(f.name for f in fields(Policy)))


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def valid_polygon(p: Column) -> Column:
    """At least three vertices of exactly two values in 0..1."""
    return F.coalesce((F.size(p) >= 3) & F.forall(p, lambda v: (F.size(v) == 2) & F.forall(v, lambda x: x.between(0, 1))), F.lit(False))


def zones(spark: SparkSession, path: str) -> DataFrame:
    """Rows (camera_id, position, name, kind, base_risk, description, objects, polygon, valid), with defaults filled in."""
    z = _json(spark, path, ZONE_FILE).select("camera_id", F.posexplode("zones").alias("position", "z"))
    return z.select(
        "camera_id", "position", "z.name", F.upper(F.coalesce("z.kind", F.lit("WATCH"))).alias("kind"), F.coalesce("z.base_risk", F.lit(50)).alias("base_risk"), F.coalesce("z.description", F.lit("")).alias("description"),
        F.transform(F.coalesce("z.objects", F.array(F.lit("PERSON"), F.lit("VEHICLE"))), lambda x: F.upper(x)).alias("objects"),
        "z.polygon", valid_polygon(F.col("z.polygon")).alias("valid"),
    )


def zone_list(spark: SparkSession, path: str) -> list[Zone]:
    """The zones of a file as policies; raises ValueError for none or an invalid polygon. Configuration, so small."""
    rows = zones(spark, path).orderBy("camera_id", "position").collect()
    if not rows or not all(r.valid for r in rows):
        raise ValueError("a zone file needs zones, each of three or more vertices in 0..1")
    return [Zone(r["name"], r.kind, r.base_risk, tuple(map(tuple, r.polygon)), tuple(r.objects), r.camera_id, r.description) for r in rows]


def calibration(spark: SparkSession, path: str) -> dict[str, tuple[float, ...]]:
    """Nine ground-plane coefficients of each calibrated camera; raises ValueError unless four points are distinct."""
    rows = _json(spark, path, ZONE_FILE).where("calibration is not null").select("camera_id", "calibration.points").collect()
    return {r.camera_id: homography([(tuple(p.image), tuple(p.world)) for p in r.points]) for r in rows}


def cameras(spark: SparkSession, path: str, settings: tuple[str, ...] = SETTINGS) -> DataFrame:
    """One row for each camera, its own settings before the file's base settings, all as text. A nested `location` counts like
    settings of the camera (its name as site); keys that begin with _ are notes. Raises ValueError for a repeated or missing
    camera_id, for a location without numeric latitude and longitude on the Earth, and for settings that are not known."""
    object_ = "map<string,string>"
    none = F.create_map().cast(object_)
    raw = _json(spark, path, FLEET_FILE).select(F.explode("cameras").alias("c"), F.coalesce("base", none).alias("b")).withColumn("c", F.from_json("c", object_))
    at = F.coalesce(F.from_json(F.col("c")["location"], object_), none)
    raw = raw.withColumn("at", F.map_from_entries(F.transform(F.map_entries(at), lambda e: F.struct(F.when(e["key"] == "name", "site").otherwise(e["key"]).alias("key"), e["value"].alias("value")))))
    own = F.map_filter("c", lambda k, v: (k != "location") & ~F.map_contains_key("at", k))
    raw = raw.withColumn("own", F.map_concat(own, "at"))
    merged = raw.select(F.map_filter(F.map_concat(F.map_filter("b", lambda k, v: ~F.map_contains_key("own", k)), "own"), lambda k, v: ~k.startswith("_")).alias("m"), F.col("c")["location"].isNotNull().alias("sited"))
    odd = merged.select(F.explode(F.map_keys("m")).alias("k")).where(~F.col("k").isin(*settings)).select("k").distinct().limit(5).collect()
    if odd:
        raise ValueError(f"unknown settings: {', '.join(r.k for r in odd)}")
    lat, lon = (F.coalesce(F.col("m")[a], F.col("m")[b]).try_cast("double") for a, b in (("lat", "latitude"), ("lon", "longitude")))
    if merged.where(F.col("sited") & ~F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))).limit(1).count():
        raise ValueError("a camera location needs numeric lat and lon on the Earth")
    out = merged.select(*[F.col("m")[s].alias(s) for s in settings])
    if out.where("camera_id is null").limit(1).count() or out.groupBy("camera_id").count().where("count > 1").limit(1).count():
        raise ValueError("every camera needs a camera_id of its own")
    return out


def places(fleet: DataFrame) -> DataFrame:
    """Cameras with lat, lon, bearing and fov under any of their names; those without a place stay, unplaced."""
    pick = lambda a, b: F.coalesce(F.col(a), F.col(b)).cast("double")
    return fleet.select("camera_id", pick("lat", "latitude").alias("lat"), pick("lon", "longitude").alias("lon"), pick("bearing", "heading").alias("bearing"), pick("fov", "field_of_view").alias("fov"), "site")


def geofences(spark: SparkSession, path: str) -> DataFrame:
    """Rows (position, name, kind, description, polygon, valid) of a fleet file's areas; vertices are (lat, lon)."""
    g = _json(spark, path, FLEET_FILE).select(F.posexplode("geofences").alias("position", "g"))
    p = F.coalesce("g.polygon", "g.points")
    fine = F.coalesce((F.size(p) >= 3) & F.forall(p, lambda v: (F.size(v) == 2) & v[0].between(-90, 90) & v[1].between(-180, 180)), F.lit(False))
    return g.select("position", F.coalesce("g.name", F.lit("AREA")).alias("name"), F.upper(F.coalesce("g.kind", F.lit("SECTOR"))).alias("kind"), F.coalesce("g.description", F.lit("")).alias("description"), p.alias("polygon"), fine.alias("valid"))


def geofence_list(spark: SparkSession, path: str) -> list[tuple[str, tuple]]:
    """(name, vertices) of the areas, as operators.site takes them; raises ValueError for an invalid one. Configuration, so small."""
    rows = geofences(spark, path).orderBy("position").collect()
    if bad := [r["name"] for r in rows if not r.valid]:
        raise ValueError(f"geofence {bad[0]!r} needs three or more points on the Earth")
    return [(r["name"], tuple(map(tuple, r.polygon))) for r in rows]


def registry(spark: SparkSession, path: str) -> DataFrame:
    return clean_registry(_json(spark, path, REGISTRY_FILE).select(F.posexplode("vehicles").alias("position", "v")).select("position", "v.*"), "position")


def roster(spark: SparkSession, path: str) -> DataFrame:
    """Rows (person_id, label, role, position, vec); persons without vectors are skipped."""
    p = _json(spark, path, ROSTER_FILE).select(F.posexplode("people").alias("n", "p"))
    return p.select(F.col("p.id").alias("person_id"), "p.label", "p.role", "n", F.posexplode("p.vectors").alias("i", "vec")).withColumn("position", F.shiftleft(F.col("n").cast("long"), 32) + F.col("i")).drop("n", "i")


def detections(spark: SparkSession, path: str, labels: list[str], confidence: float = 0.40, stream: bool = False) -> DataFrame:
    """Detections of the labels and confidence; both filters reach the Parquet scan."""
    reader = (spark.readStream if stream else spark.read).schema(DETECTIONS)
    return reader.parquet(path).where(F.col("label").isin(*labels) & (F.col("confidence") >= confidence))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Rows (filename, plate, x1, y1, x2, y2) of annotated images; names that cannot be plates and broken files are skipped."""
    a = spark.read.format("xml").schema(ANNOTATION).option("rowTag", "annotation").option("mode", "PERMISSIVE").load(path)
    o = a.select("filename", F.explode("object").alias("o")).withColumn("plate", F.regexp_replace(F.upper("o.name"), "[^A-Z0-9]", ""))
    box = [F.col(f"o.bndbox.{c}").cast("int").alias(n) for c, n in (("xmin", "x1"), ("ymin", "y1"), ("xmax", "x2"), ("ymax", "y2"))]
    return o.where((F.length("plate") >= 4) & (F.col("plate") != "LICENCE")).select("filename", "plate", *box).where("x1 is not null and y1 is not null and x2 is not null and y2 is not null")

