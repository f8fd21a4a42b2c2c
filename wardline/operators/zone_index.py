"""Zones of large fleets as a table: a grid of cells says which zones a point needs to be compared with, in a plan of fixed size."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import geometry as G
from wardline.model import DEFAULT, Policy, Zone
from wardline.operators.lineage import cut
from wardline.operators.zones import category

ZONE = "ordinal int, camera_id string, name string, kind string, priority int, base_risk int, objects array<string>, edges array<struct<x1:double,y1:double,x2:double,y2:double>>"
_EDGES = "array<struct<x1:double,y1:double,x2:double,y2:double>>"
CELLS = f"camera_id string, cell int, holds array<struct<p:int,base_risk:int,o:int,zone:string,kind:string,objects:array<string>,whole:boolean,edges:{_EDGES}>>, near array<struct<o:int,zone:string,edges:{_EDGES}>>"
#: The cell of points outside the unit square, and the edges up to which cells or outlines are sent to all tasks (32 bytes each, and some).
OUTSIDE, SENT = -1, 200_000


def zone_table(spark: SparkSession, zones: list[Zone]) -> DataFrame:
    """Rows of ZONE for zones in their order."""
    rows = [(i, z.camera_id, z.name, z.kind, z.priority, z.base_risk, list(z.objects), [tuple(map(float, e)) for e in G.edges(z.polygon)]) for i, z in enumerate(zones)]
    return spark.createDataFrame(rows, ZONE)


def loaded(zones: DataFrame) -> DataFrame:
    """Rows of ZONE from those of a zone file (`sources.config.zones`), in order of camera and position; invalid polygons fail."""
    at = lambda i, k: F.col("polygon")[F.pmod(i, F.size("polygon")).cast("int")][k].cast("double")
    edges = F.transform("polygon", lambda v, i: F.struct(v[0].cast("double").alias("x1"), v[1].cast("double").alias("y1"), at(i + 1, 0).alias("x2"), at(i + 1, 1).alias("y2")))
    priority = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in Zone.PRIORITY.items()], F.lit(0))
    ok = F.when(F.col("valid"), edges).otherwise(F.raise_error(F.concat(F.lit("not a polygon in 0..1: "), "name")).cast(_EDGES))
    return zones.select(F.col("position").cast("int").alias("ordinal"), "camera_id", "name", "kind", priority.alias("priority"), F.col("base_risk").cast("int").alias("base_risk"), "objects", ok.alias("edges"))


def crossed(x: Column, y: Column, e: Column) -> Column:
    return ((e["y1"] > y) != (e["y2"] > y)) & (x < e["x1"] + (y - e["y1"]) / (e["y2"] - e["y1"]) * (e["x2"] - e["x1"]))


def touched(x: Column, y: Column, e: Column) -> Column:
    flat = F.abs((e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])) <= G.EPS
    between = lambda v, a, b: v.between(F.least(a, b) - G.EPS, F.greatest(a, b) + G.EPS)
    return flat & between(x, e["x1"], e["x2"]) & between(y, e["y1"], e["y2"])


def inside(x: Column, y: Column, edges: Column) -> Column:
    """Whether a polygon given as an array of edges holds a point: even-odd, with the boundary inside."""
    odd = F.size(F.filter(edges, lambda e: crossed(x, y, e))) % 2 == 1
    return (F.size(edges) >= 3) & (F.exists(edges, lambda e: touched(x, y, e)) | odd)


def on_edge(x: Column, y: Column, e: Column) -> tuple[Column, Column]:
    """The nearest point of an edge."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    n = dx * dx + dy * dy
    t = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["x1"]) * dx + (y - e["y1"]) * dy) / n)))
    return e["x1"] + t * dx, e["y1"] + t * dy


def distance(x: Column, y: Column, edges: Column) -> Column:
    """0 inside, else how far the nearest edge is."""
    return F.when(inside(x, y, edges), 0.0).otherwise(F.array_min(F.transform(edges, lambda e: G.distance(x, y, *on_edge(x, y, e)))))


def nearest_point(x: Column, y: Column, z: Column, shared: bool) -> Column:
    """struct(d, o, e, zone, x, y, shared) of a zone: its nearest point, of the first edge on a tie; the point itself inside."""

    def of(d, e, px, py):
        return F.struct(d.alias("d"), z["o"].alias("o"), e.alias("e"), z["zone"].alias("zone"), px.alias("x"), py.alias("y"), F.lit(shared).alias("shared"))

    def edge(e, i):
        px, py = on_edge(x, y, e)
        return of(G.distance(x, y, px, py), i, px, py)

    return F.when(inside(x, y, z["edges"]), of(F.lit(0.0), F.lit(-1), x, y)).otherwise(F.array_min(F.transform(z["edges"], edge)))


def sent(table: DataFrame, edges: Column) -> DataFrame:
    """table with a broadcast hint if it is small, going by its rows and the edges in it. It is read for that; give it what is cut."""
    n = table.agg(F.count("*") + F.coalesce(F.sum(edges), F.lit(0))).first()[0]
    return F.broadcast(table) if n <= SENT else table


def _cells(grid: int, armed: tuple[str, ...]):
    """The cells of one camera's zones (or of those for all cameras), as rows of CELLS."""
    c = (np.arange(grid) + 0.5) / grid
    cx, cy = (a.ravel() for a in np.meshgrid(c, c))
    radius = 0.5**0.5 / grid + 1e-6  # of a cell, and some for rounding

    def work(t: pa.Table) -> pa.Table:
        zones = sorted(t.to_pylist(), key=lambda z: (-z["priority"], -z["base_risk"], z["ordinal"]))
        holds, low, high = [[] for _ in range(grid * grid + 1)], [], []
        near_of = [z for z in zones if z["kind"] in armed]
        for z in zones:
            e = np.array([[k["x1"], k["y1"], k["x2"], k["y2"]] for k in z["edges"]])
            x1, y1, dx, dy = e[:, 0], e[:, 1], e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
            n = dx * dx + dy * dy
            s = np.clip(((cx[:, None] - x1) * dx + (cy[:, None] - y1) * dy) / np.where(n == 0, 1, n), 0, 1) * (n > 0)
            d = np.hypot(cx[:, None] - x1 - s * dx, cy[:, None] - y1 - s * dy).min(axis=1)
            up = (y1 > cy[:, None]) != (e[:, 3] > cy[:, None])
            odd = (up & (cx[:, None] < x1 + (cy[:, None] - y1) / np.where(dy == 0, 1, dy) * dx)).sum(axis=1) % 2 == 1
            item = {"p": z["priority"], "base_risk": z["base_risk"], "o": -z["ordinal"], "zone": z["name"], "kind": z["kind"], "objects": z["objects"], "edges": z["edges"]}
            for k in np.flatnonzero(odd | (d <= radius)).tolist():
                clear = bool(d[k] > radius)
                holds[k].append(item | {"whole": clear, "edges": [] if clear else z["edges"]})
            holds[-1].append(item | {"whole": False})
            if z["kind"] in armed:
                far = np.where(odd & (len(e) >= 3), 0.0, d)
                low.append(far - radius)
                high.append(far + radius)
        near = [[] for _ in holds]
        if near_of:
            wanted = np.array(low) <= np.array(high).min(axis=0)
            for k, cell in enumerate(wanted.T):
                near[k] = [near_of[j] for j in np.flatnonzero(cell)]
            near[-1] = near_of
        rows = [
            {"camera_id": zones[0]["camera_id"], "cell": k if k < grid * grid else OUTSIDE, "holds": holds[k], "near": [{"o": z["ordinal"], "zone": z["name"], "edges": z["edges"]} for z in near[k]]}
            for k in range(len(holds)) if holds[k] or near[k]
        ]
        return pa.Table.from_pylist(rows, _SCHEMA)

    return work


_E = pa.list_(pa.struct([(c, pa.float64()) for c in ("x1", "y1", "x2", "y2")]))
_SCHEMA = pa.schema([
    ("camera_id", pa.string()), ("cell", pa.int32()),
    ("holds", pa.list_(pa.struct([("p", pa.int32()), ("base_risk", pa.int32()), ("o", pa.int32()), ("zone", pa.string()), ("kind", pa.string()), ("objects", pa.list_(pa.string())), ("whole", pa.bool_()), ("edges", _E)]))),
    ("near", pa.list_(pa.struct([("o", pa.int32()), ("zone", pa.string()), ("edges", _E)]))),
])


@dataclass(frozen=True)
class ZoneIndex:
    """Cells of zones: rows of CELLS. A point lies in one cell of its camera and one of the zones for all cameras. `holds` are the
    zones that reach into the cell, best first; one that covers it whole needs no comparison. `near` are the armed zones that
    may be the nearest to some point of the cell."""

    cells: DataFrame
    grid: int

    @classmethod
    def build(cls, zones: DataFrame, grid: int = 16, policy: Policy = DEFAULT) -> ZoneIndex:
        """zones: rows of ZONE. Each camera's zones are one group, as they are one frame's plan."""
        cells = cut(zones.groupBy("camera_id").applyInArrow(_cells(grid, tuple(policy.alert_kinds)), CELLS))
        each = lambda zones: F.aggregate(zones, F.lit(0).cast("long"), lambda n, z: n + 1 + F.size(z["edges"]))
        return cls(sent(cells, each(F.col("holds")) + each(F.col("near"))), grid)

    def outlined(self, rows: DataFrame, nearest: str, name: str, camera: str = "camera_id") -> DataFrame:
        """rows with the edges (column name) of the zone that is their `nearest` by place()."""
        some = self.cells.select("camera_id", F.explode("near").alias("z")).groupBy("camera_id", "z.o", "z.zone").agg(F.first("z.edges").alias(name))
        some = some.select(F.col("camera_id").alias("_camera"), F.col("o").alias("_o"), F.col("zone").alias("_zone"), name)
        some = sent(cut(some), F.size(name))
        at = F.when(~F.col(f"{nearest}.shared"), F.col(camera))
        return rows.join(some, F.col("_camera").eqNullSafe(at) & (F.col("_o") == F.col(f"{nearest}.o")) & (F.col("_zone") == F.col(f"{nearest}.zone")), "left").drop("_camera", "_o", "_zone")

    def place(self, obs: DataFrame, x: str = "nx", y: str = "ny", camera: str = "camera_id", label: str = "label", nearest: str = "nearest") -> DataFrame:
        """obs with zone, zone_kind, base_risk, as `zones.locate`, and `nearest`, as `zones.nearest_armed`, and whether that
        zone is one for all cameras (shared); `outlined` gives its edges. Two joins on (camera, cell) serve any number of zones; each observation gives one row."""
        px, py = F.col(x), F.col(y)
        at = lambda v: F.least(F.floor(v * self.grid), F.lit(self.grid - 1))
        unit = px.between(0, 1) & py.between(0, 1)
        obs = obs.withColumn("cell_", F.when(unit, at(py) * self.grid + at(px)).otherwise(OUTSIDE).cast("int"))
        own = self.cells.where("camera_id is not null").select(F.col("camera_id").alias("camera_"), F.col("cell").alias("cell1_"), F.col("holds").alias("holds1_"), F.col("near").alias("near1_"))
        shared = self.cells.where("camera_id is null").select(F.col("cell").alias("cell2_"), F.col("holds").alias("holds2_"), F.col("near").alias("near2_"))
        out = obs.join(own, (F.col(camera) == F.col("camera_")) & (F.col("cell_") == F.col("cell1_")), "left").join(shared, F.col("cell_") == F.col("cell2_"), "left")

        def first(zones: str) -> Column:
            return F.get(F.filter(zones, lambda z: z["whole"] | inside(px, py, z["edges"])), F.lit(0))

        def closest(zones: str, shared: bool) -> Column:
            return F.array_min(F.transform(zones, lambda z: nearest_point(px, py, z, shared)))

        out = out.withColumns({"best_": F.greatest(first("holds1_"), first("holds2_")), nearest: F.least(closest("near1_", False), closest("near2_", True))})
        ok = F.array_contains("best_.objects", category(F.col(label)))
        out = out.withColumns({"zone": F.when(ok, F.col("best_.zone")), "zone_kind": F.when(ok, F.col("best_.kind")), "base_risk": F.when(ok, F.col("best_.base_risk"))})
        return out.drop("cell_", "camera_", "cell1_", "holds1_", "near1_", "cell2_", "holds2_", "near2_", "best_")
