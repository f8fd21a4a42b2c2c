"""Zones as a joined table of cells against zones unrolled into the plan."""

import random

import pytest
from oracle import same
from pyspark.sql import functions as F

from wardline.model import Zone
from wardline.operators import zones as Z
from wardline.operators.zone_index import ZoneIndex, loaded, zone_table
from wardline.plans import tracks

KINDS = ("RESTRICTED", "WATCH", "PATROL", "OTHER")


def some_zones(draw, n, cameras):
    out = []
    for i in range(n):
        x, y, r = draw.random(), draw.random(), draw.choice([0.01, 0.1, 0.4])
        clip = lambda v: min(1.0, max(0.0, round(v, draw.choice([1, 2, 6]))))
        polygon = tuple((clip(x + draw.uniform(-r, r)), clip(y + draw.uniform(-r, r))) for _ in range(draw.randint(3, 7)))
        out.append(Zone(f"z{i}", draw.choice(KINDS), draw.choice([20, 50]), polygon, draw.choice([("PERSON",), ("PERSON", "VEHICLE")]), draw.choice([*cameras, None])))
    return out


@pytest.mark.parametrize("grid", [1, 16])
def test_same_as_unrolled(spark, grid):
    draw = random.Random(grid)
    zones = some_zones(draw, 14, ["A", "B"])
    points = [(i, draw.choice(["A", "B", "C", None]), draw.choice([draw.random(), round(draw.random(), 1), -0.2, 1.0, 1.3]), draw.choice([draw.random(), round(draw.random(), 1), 0.0, 1.0]), draw.choice(["PERSON", "CAR"])) for i in range(600)]
    points += [(1000 + i, "A", *z.polygon[0], "PERSON") for i, z in enumerate(zones)]
    obs = spark.createDataFrame(points, "id int, camera_id string, nx double, ny double, label string")
    got = ZoneIndex.build(zone_table(spark, zones), grid).place(obs).selectExpr("id", "zone", "zone_kind", "base_risk", "nearest.zone as target", "round(nearest.d, 9) as d", "nearest.e as e", "round(nearest.x, 9) as x", "round(nearest.y, 9) as y")
    t = Z.nearest_armed(F.col("nx"), F.col("ny"), zones, camera=F.col("camera_id"))
    want = Z.locate(obs, zones).withColumn("t", t).selectExpr("id", "zone", "zone_kind", "base_risk", "t.zone", "round(t.d, 9)", "t.e", "round(t.x, 9)", "round(t.y, 9)")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_plan_of_fixed_size(spark):
    """10,000 zones make the same plan as three, and a point is compared with few."""
    obs = spark.range(200).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("C"), (F.col("id") % 50).cast("string")).alias("camera_id"), (F.col("id") % 17 / 17).alias("nx"), (F.col("id") % 13 / 13).alias("ny"), F.lit("PERSON").alias("label"))
    many = some_zones(random.Random(1), 10_000, [f"C{i}" for i in range(100)])
    plans = []
    for zones in (many[:3], many):
        index = ZoneIndex.build(zone_table(spark, zones), 4)
        out = index.place(obs)
        plans.append(len(out._jdf.queryExecution().optimizedPlan().toString()))
        assert out.count() == 200
    assert abs(plans[0] - plans[1]) < 200
    mine = [z for z in many if z.camera_id == "C3"]
    alone = ZoneIndex.build(zone_table(spark, mine), 4).place(obs).where("camera_id = 'C3'").select("id", "zone")
    assert 30 < len(mine) < 200 and sorted(map(tuple, alone.collect()), key=repr) == sorted(map(tuple, Z.locate(obs, mine).where("camera_id = 'C3'").select("id", "zone").collect()), key=repr)
    held = index.cells.where("camera_id is not null and cell >= 0").select(F.avg(F.size("holds")), F.max(F.size("near"))).first()
    assert held[0] < 60


def test_from_a_zone_file(spark, tmp_path):
    import json

    from wardline.sources import config

    (tmp_path / "z.json").write_text(json.dumps({"camera_id": "C", "zones": [{"name": "a", "kind": "restricted", "polygon": [[0, 0], [1, 0], [1, 1]]}, {"name": "b", "polygon": [[0, 0], [0.5, 1], [0, 1]]}]}))
    zones = loaded(config.zones(spark, str(tmp_path / "z.json")))
    obs = spark.createDataFrame([(1, "C", 0.9, 0.5, "CAR"), (2, "C", 0.1, 0.9, "CAR"), (3, "D", 0.9, 0.5, "CAR")], "id int, camera_id string, nx double, ny double, label string")
    got = {r.id: (r.zone, r.nearest and r.nearest.zone) for r in ZoneIndex.build(zones).place(obs).collect()}
    assert got == {1: ("a", "a"), 2: ("b", "a"), 3: (None, None)}


@pytest.mark.parametrize("name", ["zone_locate_indexed", "zone_nearest_indexed", "severity_by_zone_indexed"])
def test_oracle(spark, name):
    same(spark, "/root/testdata/sf0.001", tracks.QUERIES[name], tracks.ORACLE[name])
