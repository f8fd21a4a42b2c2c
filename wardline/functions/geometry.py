"""Column expressions over boxes, points and polygons. Polygons are short lists of vertices and unroll into plain arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9
EARTH_M = 6371008.8
# Compass points anticlockwise from the right.
COMPASS = ("E", "NE", "N", "NW", "W", "SW", "S", "SE")


def edges(polygon):
    return [(*polygon[i], *polygon[(i + 1) % len(polygon)]) for i in range(len(polygon))]


def _any(cols):
    out = F.lit(False)
    for c in cols:
        out = out | c
    return out


def even_odd(x: Column, y: Column, polygon) -> Column:
    """Even-odd rule; points on the boundary may fall either way. Terms that are zero on an upright edge are left out: generated methods
    above 8,000 bytes are not compiled to machine code, so the shorter the better."""
    if len(polygon) < 3:
        return F.lit(False)
    n = F.lit(0)
    for x1, y1, x2, y2 in edges(polygon):
        if y1 != y2:
            cross = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x1 if x1 == x2 else x1 + (y - y1) / (y2 - y1) * (x2 - x1)))
            n = n + F.when(cross, 1).otherwise(0)
    return n % 2 == 1


def on_boundary(x: Column, y: Column, polygon) -> Column:
    def off(x1, y1, x2, y2):
        if y1 == y2:
            return (x2 - x1) * (y - y1)
        return (y2 - y1) * (x - x1) if x1 == x2 else (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)

    return _any(
        (F.abs(off(x1, y1, x2, y2)) <= EPS) & x.between(min(x1, x2) - EPS, max(x1, x2) + EPS) & y.between(min(y1, y2) - EPS, max(y1, y2) + EPS)
        for x1, y1, x2, y2 in edges(polygon)
    )


def solid(v: Column) -> Column:
    """v, or NaN where it is null: arithmetic over columns without nulls generates a fraction of the code. NaN is inside nothing."""
    return F.coalesce(v, F.lit(float("nan")))


def inside(x: Column, y: Column, polygon) -> Column:
    """Even-odd rule, with the boundary inside; false for fewer than three vertices."""
    return F.lit(False) if len(polygon) < 3 else on_boundary(x, y, polygon) | even_odd(x, y, polygon)


def nearest_on_segment(x: Column, y: Column, x1, y1, x2, y2) -> tuple[Column, Column]:
    dx, dy = x2 - x1, y2 - y1
    if dx == 0 and dy == 0:
        return F.lit(float(x1)), F.lit(float(y1))
    along = (x - x1) * dx if dy == 0 else (y - y1) * dy if dx == 0 else (x - x1) * dx + (y - y1) * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along / (dx * dx + dy * dy)))
    return F.lit(float(x1)) if dx == 0 else x1 + t * dx, F.lit(float(y1)) if dy == 0 else y1 + t * dy


def distance(ax, ay, bx, by) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def edge_points(x: Column, y: Column, polygon, **extra: Column) -> list[Column]:
    """struct(d, e, x, y) for each edge: its nearest point and how far that is. Extra fields o and zone keep o before e."""
    out = []
    for i, e in enumerate(edges(polygon)):
        px, py = nearest_on_segment(x, y, *e)
        named = {"e": F.lit(i), "x": px, "y": py} | extra
        order = ("o", "e", "zone", "x", "y")
        out.append(F.struct(distance(x, y, px, py).alias("d"), *[named[k].alias(k) for k in order if k in named]))
    return out


def closest_on_polygon(x: Column, y: Column, polygon) -> Column:
    """struct(d, e, x, y): the nearest point of the polygon, the first edge on a tie; the point itself inside."""
    own = F.struct(F.lit(0.0).alias("d"), F.lit(-1).alias("e"), x.alias("x"), y.alias("y"))
    return F.when(inside(x, y, polygon), own).otherwise(F.least(*edge_points(x, y, polygon)))


def distance_to_polygon(x: Column, y: Column, polygon) -> Column:
    """0 inside, else the distance to the nearest edge."""
    return F.when(inside(x, y, polygon), F.lit(0.0)).otherwise(F.least(*[distance(x, y, *nearest_on_segment(x, y, *e)) for e in edges(polygon)]))


def centroid(x1, y1, x2, y2) -> tuple[Column, Column]:
    return F.floor((x1 + x2) / 2), F.floor((y1 + y2) / 2)


def ground_point(x1, y1, x2, y2) -> tuple[Column, Column]:
    """Middle of the bottom edge."""
    return F.floor((x1 + x2) / 2), y2


def area(x1, y1, x2, y2) -> Column:
    return F.greatest(x2 - x1, F.lit(0)) * F.greatest(y2 - y1, F.lit(0))


def apparent_size(x1: Column, y1: Column, x2: Column, y2: Column, clip: float = 0.995) -> tuple[Column, Column, Column]:
    """Height and area of a normalised box as shares of the frame, and whether it runs out of the frame at the bottom; zeros and false
    without a box."""
    w, h = F.greatest(x2 - x1, F.lit(0.0)), F.greatest(y2 - y1, F.lit(0.0))
    return F.coalesce(h, F.lit(0.0)), F.coalesce(w * h, F.lit(0.0)), F.coalesce(y2 >= clip, F.lit(False))


def track_label(track: Column) -> Column:
    return F.when(track.isNull(), "P---").otherwise(F.format_string("P%03d", track))


def normalize(v: Column, size: int) -> Column:
    if size <= 0:
        raise ValueError("a frame has a positive size")
    return v / F.lit(float(size))


def denormalize(v: Column, size: int) -> Column:
    return F.bround(v * size, 0).cast("int")


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2)."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0))
    union = area(*a) + area(*b) - w * h
    return F.when((w * h > 0) & (union > 0), w * h / union).otherwise(F.lit(0.0))


def part_of_box(x1, y1, x2, y2, left: float, top: float, right: float, bottom: float, from_top: bool) -> list[Column]:
    """A part of a box by shares of its size, cut towards zero; bottom is measured from the top edge if from_top."""
    w, h = F.greatest(x2 - x1, F.lit(0)), F.greatest(y2 - y1, F.lit(0))
    cut = lambda v, s: (v * s).cast("int")
    return [x1 + cut(w, left), y1 + cut(h, top), x2 - cut(w, right), y1 + cut(h, bottom) if from_top else y2 - cut(h, bottom)]


def torso(*box) -> list[Column]:
    return part_of_box(*box, 0.20, 0.15, 0.20, 0.55, True)


def body(*box) -> list[Column]:
    return part_of_box(*box, 0.15, 0.35, 0.15, 0.10, False)


def plate_search(x1, y1, x2, y2, lower: float = 0.40) -> list[Column]:
    return [x1, y1 + ((y2 - y1) * lower).cast("int"), x2, y2]


def compass(dx: Column, dy: Column) -> Column:
    """Heading of a step in image coordinates, in which y grows downwards."""
    angle = F.pmod(F.degrees(F.atan2(-dy, dx)), F.lit(360.0))
    return F.element_at(F.array(*map(F.lit, COMPASS)), (F.floor(F.pmod(angle + 22.5, F.lit(360.0)) / 45) + 1).cast("int"))


def project(x: Column, y: Column, m: tuple[float, ...]) -> tuple[Column, Column]:
    """Image point to ground coordinates by nine row-major coefficients."""
    w = m[6] * x + m[7] * y + m[8]
    return (m[0] * x + m[1] * y + m[2]) / w, (m[3] * x + m[4] * y + m[5]) / w


def homography(pairs) -> tuple[float, ...]:
    """Nine coefficients from four (image, world) pairs; raises ValueError unless they are four distinct, general points."""
    import numpy as np

    if len(pairs) != 4 or len({p[0] for p in pairs}) != 4 or len({p[1] for p in pairs}) != 4:
        raise ValueError("a calibration needs four distinct image and four distinct world points")
    rows, right = [], []
    for (x, y), (u, v) in pairs:
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    a = np.array(rows, float)
    if np.linalg.cond(a) > 1e12:
        raise ValueError("three of the calibration points are on a line")
    return (*map(float, np.linalg.solve(a, np.array(right, float))), 1.0)


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def destination(lat: Column, lon: Column, bearing: Column, metres: float) -> tuple[Column, Column]:
    """Where a great circle of that length and first bearing (degrees) ends."""
    d, b, p = metres / EARTH_M, F.radians(bearing), F.radians(lat)
    q = F.asin(F.sin(p) * math.cos(d) + F.cos(p) * math.sin(d) * F.cos(b))
    l2 = F.radians(lon) + F.atan2(F.sin(b) * math.sin(d) * F.cos(p), math.cos(d) - F.sin(p) * F.sin(q))
    return F.degrees(q), F.pmod(F.degrees(l2) + 540.0, F.lit(360.0)) - 180.0


def person_px(range_m: Column, frame_h: int, vfov_deg: float, height_m: float = 1.7) -> Column:
    """Pixel height of a person at a distance."""
    return frame_h * height_m / (2 * range_m * math.tan(math.radians(vfov_deg) / 2))
