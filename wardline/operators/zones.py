"""Where detections are: zones, nearest armed zones, object classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import geometry as G
from wardline.model import CLASSES, DEFAULT, Policy, Zone


def class_column(label: Column, field: int, default) -> Column:
    """A field of CLASSES by label (2: category, 3: weight), or the default for an unknown label."""
    out = None
    for c in CLASSES:
        out = F.when(label == c[1], c[field]) if out is None else out.when(label == c[1], c[field])
    return out.otherwise(default)


def category(label: Column) -> Column:
    return class_column(label, 2, "PERSON")


def weight(label: Column) -> Column:
    return class_column(label, 3, 1.0)


def resolve_labels(selectors: list[str]) -> list[str]:
    """Distinct labels of class, category or `all` selectors, in order; raises ValueError for an unknown or empty list."""
    out: list[str] = []
    for s in selectors:
        key = str(s).strip().upper()
        found = [c[1] for c in CLASSES if key in ("ALL", c[1], c[2])]
        if not found:
            raise ValueError(f"unknown class selector {s!r}")
        out += [x for x in found if x not in out]
    if not out:
        raise ValueError("no classes selected")
    return out


def _here(z: Zone, camera: Column) -> Column:
    return F.lit(True) if z.camera_id is None else camera == z.camera_id


def locate(obs: DataFrame, zones: list[Zone], x: str = "nx", y: str = "ny", camera: str = "camera_id", label: str = "label") -> DataFrame:
    """obs with zone, zone_kind, base_risk: the zone of the highest (priority, base risk) that holds the point, the first in
    order on a tie; null if the winner does not apply to the object's category. Zones are a short configured list."""
    cands = [
        F.when(_here(z, F.col(camera)) & G.inside(F.col("_x"), F.col("_y"), z.polygon), F.struct(
            F.lit(z.priority).alias("p"), F.lit(z.base_risk).alias("base_risk"), F.lit(-i).alias("o"), F.lit(z.name).alias("zone"), F.lit(z.kind).alias("kind"),
            F.array(*map(F.lit, z.objects)).alias("objects")))
        for i, z in enumerate(zones)
    ]
    best = F.greatest(*cands) if len(cands) > 1 else cands[0]
    out = obs.withColumns({"_x": G.solid(F.col(x)), "_y": G.solid(F.col(y))}).withColumn("_z", best)
    ok = F.array_contains("_z.objects", category(F.col(label)))
    return out.withColumns({"zone": F.when(ok, F.col("_z.zone")), "zone_kind": F.when(ok, F.col("_z.kind")), "base_risk": F.when(ok, F.col("_z.base_risk"))}).drop("_z", "_x", "_y")


def armed(zones: list[Zone], policy: Policy = DEFAULT) -> list[Zone]:
    return [z for z in zones if z.kind in policy.alert_kinds]


def nearest_armed(x: Column, y: Column, zones: list[Zone], policy: Policy = DEFAULT, camera: Column | None = None) -> Column:
    """struct(d, o, e, zone, x, y): the nearest armed zone and its nearest point, the first on a tie; null if none is armed."""
    cands = []
    for i, z in enumerate(armed(zones, policy)):
        own = F.when(G.inside(x, y, z.polygon), F.struct(F.lit(0.0).alias("d"), F.lit(i).alias("o"), F.lit(-1).alias("e"), F.lit(z.name).alias("zone"), x.alias("x"), y.alias("y")))
        for s in (own, *G.edge_points(x, y, z.polygon, o=F.lit(i), zone=F.lit(z.name))):
            cands.append(s if z.camera_id is None or camera is None else F.when(camera == z.camera_id, s))
    if not cands:
        return F.lit(None).cast("struct<d:double,o:int,e:int,zone:string,x:double,y:double>")
    return F.least(*cands)


def distances(df: DataFrame, zones: list[Zone], policy: Policy = DEFAULT, name: str = "distances", x: str = "nx", y: str = "ny", camera: str = "camera_id") -> DataFrame:
    """df with an array of how far the point is from each armed zone, 0 inside, null for another camera's; null without a point."""
    each = [F.when(_here(z, F.col(camera)), G.distance_to_polygon(F.col("_x"), F.col("_y"), z.polygon)) for z in armed(zones, policy)]
    out = df.withColumns({"_x": G.solid(F.col(x)), "_y": G.solid(F.col(y))})
    return out.withColumn(name, F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.array(*each).cast("array<double>"))).drop("_x", "_y")


def nearest_of(distances: Column, zones: list[Zone], policy: Policy = DEFAULT, camera: Column | None = None) -> tuple[Column, Column, Column]:
    """Place, name and distance of the nearest armed zone, the first on a tie, by distances(); a row without a point has the first one's
    name and no distance."""
    some = armed(zones, policy)
    d = F.array_min(distances)
    place = F.array_position(distances, d).cast("int")
    names = F.array(*[F.lit(z.name) for z in some]).cast("array<string>")
    first = F.coalesce(*[F.when(F.lit(True) if camera is None else _here(z, camera), F.lit(z.name)) for z in some], F.lit(None).cast("string"))
    return place, F.coalesce(F.get(names, place - 1), first), d
