"""Where the cameras are."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import geometry as G
from wardline.operators.lineage import cut


def nearest(cameras: DataFrame, k: int = 3, cell: float = 0.01, few: int = 20_000) -> DataFrame:
    """The k nearest other cameras of each, by great circle (ties by id): rows (camera_id, other_id, metres, nth).

    Up to `few` placed cameras are compared with a broadcast copy of themselves. More are dealt into cells of `cell` degrees, and
    each camera sees its own and the eight around it; those whose k-th neighbour may be farther than the edge of these do so
    again with cells twice as wide. The results are the same. Each round is cut off from the last by a checkpoint.
    """
    c = cameras.where("lat is not null and lon is not null").select("camera_id", "lat", "lon")
    metres = G.haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    w = Window.partitionBy("camera_id").orderBy("metres", "other_id")
    cols = ["camera_id", "other_id", "metres", "nth"]
    o = c.select(F.col("camera_id").alias("other_id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    if c.limit(few + 1).count() <= few:  # a fleet: small enough to compare with a broadcast copy of itself
        d = c.join(F.broadcast(o), F.col("camera_id") != F.col("other_id")).withColumn("metres", metres)
        return d.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k).select(*cols)
    left = c.withColumn("narrow", F.min(F.cos(F.radians("lat"))).over(Window.partitionBy("camera_id")))
    done = []
    while True:
        n = max(1, int(360 // cell))  # cells around the globe, a little wider than `cell`
        gx, gy = (lambda lon: F.pmod(F.floor((lon.cast("double") + 180) * n / 360), F.lit(n))), (lambda lat: F.floor((lat.cast("double") + 90) * n / 360))  # noqa: B023
        around = lambda g: F.sequence(g - 1, g + 1)
        a = left.withColumn("gx", F.explode(F.array_distinct(F.transform(around(gx(F.col("lon"))), lambda x: F.pmod(x, F.lit(n))))))  # noqa: B023
        a = a.withColumn("gy", F.explode(around(gy(F.col("lat")))))
        d = a.join(o.withColumns({"gx": gx(F.col("lon2")), "gy": gy(F.col("lat2"))}), ["gx", "gy"]).where("camera_id <> other_id").withColumn("metres", metres)
        top = d.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)
        if n == 1:
            done.append(top.select(*cols))
            break
        # Whatever is not in the nine cells is at least one cell away in latitude or longitude; the meridian so far away is nearest
        # where the sine of the arc is cos(lat) * sin(angle). A little less, for rounding.
        edge = G.EARTH_M * F.asin(F.greatest(F.col("narrow"), F.lit(0.0)) * math.sin(min(math.radians(360 / n), math.pi / 2))) * (1 - 1e-9) - 1e-3
        top = top.withColumn("sure", F.max(F.when((F.col("nth") == k) & (F.col("metres") < edge), 1).otherwise(0)).over(Window.partitionBy("camera_id"))).where("sure = 1").select(*cols)
        top = cut(top)
        done.append(top)
        left = cut(left.join(top.select("camera_id").distinct(), "camera_id", "left_anti"))
        if left.isEmpty():
            break
        cell *= 2
    return reduce(DataFrame.unionAll, done)


def wedge(lat: Column, lon: Column, bearing: Column, fov: Column, metres: float = 60.0, steps: int = 12) -> Column:
    """Ring of a camera's view: apex, steps + 1 points of the arc, apex; empty without bearing and field of view. A view all
    around is a ring of 36 points, closed."""
    def at(b):
        y, x = G.destination(lat, lon, b, metres)
        return F.struct(y.alias("lat"), x.alias("lon"))

    apex = F.array(F.struct(lat.alias("lat"), lon.alias("lon")))
    arc = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: at(bearing - fov / 2 + fov * i / steps))
    circle = F.transform(F.sequence(F.lit(0), F.lit(36)), lambda i: at(i * 10.0))
    empty = F.array().cast("array<struct<lat:double,lon:double>>")
    return F.when(bearing.isNull() | fov.isNull(), empty).when(fov >= 360, circle).otherwise(F.concat(apex, arc, apex))


def fences_of(lat: Column, lon: Column, fences: list[tuple[str, tuple]]) -> Column:
    """Names of the areas that hold the camera, in order of the list; none for a camera without a place. Vertices are
    (lat, lon); points on a boundary may fall either way."""
    found = [F.when(G.even_odd(lon, lat, tuple((x, y) for y, x in poly)), name) for name, poly in fences]
    return F.when(lat.isNull() | lon.isNull(), F.array().cast("array<string>")).otherwise(F.filter(F.array(*found), lambda x: x.isNotNull()))


def valid_place(lat: Column, lon: Column, bearing: Column, fov: Column) -> Column:
    ok = lat.between(-90, 90) & lon.between(-180, 180)
    return F.coalesce(ok & (bearing.isNull() | ((bearing >= 0) & (bearing < 360))) & (fov.isNull() | ((fov > 0) & (fov <= 360))), F.lit(False))


def map_counts(cameras: DataFrame) -> DataFrame:
    """One row: cameras, located, unplaced, half_surveyed and all_round ones."""
    n = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return cameras.agg(F.count("*").alias("cameras"), n(placed, "located"), n(~placed, "unplaced"), n(placed & (F.col("bearing").isNull() != F.col("fov").isNull()), "half_surveyed"), n(placed & F.coalesce(F.col("fov") >= 360, F.lit(False)), "all_round"))


def site_map(cameras: DataFrame, fences: list[tuple[str, tuple]]) -> DataFrame:
    """Cameras with their view and areas, in order of their ids."""
    c = cameras.withColumns({
        "located": F.col("lat").isNotNull() & F.col("lon").isNotNull(), "all_round": F.coalesce(F.col("fov") >= 360, F.lit(False)),
        "half_surveyed": F.col("bearing").isNull() != F.col("fov").isNull(), "view": wedge(F.col("lat"), F.col("lon"), F.col("bearing"), F.col("fov")), "areas": fences_of(F.col("lat"), F.col("lon"), fences)})
    return c.orderBy("camera_id")
