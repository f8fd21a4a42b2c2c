"""Views derived from the driver's tables, in SQL that Spark and DuckDB both run (see FIXTURES.md), in order of use."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_obs": """
SELECT event_id, user_id AS track_id, concat('CAM-0', CAST(user_id % 5 + 1 AS VARCHAR(2))) AS camera_id,
  CASE WHEN user_id % 2 = 0 THEN 'PERSON' WHEN user_id % 7 = 1 THEN 'TRUCK' WHEN user_id % 7 = 3 THEN 'MOTORCYCLE' ELSE 'CAR' END AS label,
  event_type, value, ts, k,
  SUM(CASE WHEN k = 1 THEN 0 WHEN value > 200 THEN 70000 WHEN value > 120 THEN 3000 ELSE 500 END)
    OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stream_ms,
  (user_id * 37 + k * (5 + user_id % 9)) % 960 AS fx, 270 + (user_id * 53 + k * 4) % 270 AS fy,
  60 + (user_id * 11 + k * 3) % 340 AS bh,
  40 + event_id % 60 AS conf_pct
FROM (SELECT event_id, user_id, event_type, value, ts,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) e""",
    "fx_zone": """
SELECT * FROM (VALUES
 ('RESTRICTED','RESTRICTED',3,60,'PERSON,VEHICLE'),('WATCH','WATCH',2,30,'PERSON,VEHICLE'),
 ('PATROL-L','PATROL',1,20,'PERSON')) t(zone_name, kind, priority, base_risk, objects)""",
    "fx_edge": """
SELECT zone_name, i, CAST(x1 AS DOUBLE) x1, CAST(y1 AS DOUBLE) y1, CAST(x2 AS DOUBLE) x2, CAST(y2 AS DOUBLE) y2 FROM (VALUES
 ('RESTRICTED',0,0.55,0.50,1.0,0.50),('RESTRICTED',1,1.0,0.50,1.0,1.0),('RESTRICTED',2,1.0,1.0,0.55,1.0),('RESTRICTED',3,0.55,1.0,0.55,0.50),
 ('WATCH',0,0.30,0.50,0.60,0.50),('WATCH',1,0.60,0.50,0.60,1.0),('WATCH',2,0.60,1.0,0.30,1.0),('WATCH',3,0.30,1.0,0.30,0.50),
 ('PATROL-L',0,0.05,0.55,0.25,0.55),('PATROL-L',1,0.25,0.55,0.25,0.75),('PATROL-L',2,0.25,0.75,0.15,0.75),('PATROL-L',3,0.15,0.75,0.15,0.95),('PATROL-L',4,0.15,0.95,0.05,0.95),('PATROL-L',5,0.05,0.95,0.05,0.55)
 ) t(zone_name,i,x1,y1,x2,y2)""",
    "fx_plate": """
SELECT track_id, concat(substr('DLMHUPPBKA', CAST(track_id % 5 AS INT)*2+1, 2), lpad(CAST(track_id % 100 AS STRING),2,'0'),
  chr(CAST(65 + track_id % 26 AS INT)), chr(CAST(65 + (track_id*7) % 26 AS INT)), lpad(CAST((track_id*7919) % 10000 AS STRING),4,'0')) AS true_plate
 FROM (SELECT DISTINCT user_id AS track_id FROM events WHERE user_id % 2 = 1) u""",
    "fx_ocr": """
SELECT o.event_id, o.camera_id, o.track_id, o.k, o.stream_ms, o.label, p.true_plate,
  CASE o.k % 5 WHEN 0 THEN concat(substr(p.true_plate,1,2),' ',substr(p.true_plate,3))
               WHEN 1 THEN concat(substr(p.true_plate,1,2), replace(substr(p.true_plate,3),'0','O'))
               WHEN 2 THEN concat(substr(p.true_plate,1,8), CAST((o.k*3) % 10 AS STRING), substr(p.true_plate,10))
               WHEN 3 THEN lower(p.true_plate)
               ELSE 'TAXI' END AS raw,
  (12 + o.event_id % 80) AS ocr_conf_pct, (o.event_id*13) % 120 AS sharpness, 120 + o.bh AS veh_w, (120 + o.bh)*o.bh AS veh_area
 FROM fx_obs o JOIN fx_plate p ON o.track_id = p.track_id""",
    "fx_registry": """
SELECT true_plate AS plate, CASE track_id % 6 WHEN 1 THEN 'Motor Car' WHEN 3 THEN 'Goods Carrier' ELSE 'Hovercraft' END AS vehicle_class,
  CASE WHEN track_id % 17 = 0 THEN 'STOLEN' ELSE 'ACTIVE' END AS status FROM fx_plate WHERE track_id % 3 <> 2""",
    "fx_link": """
SELECT event_id, concat('CAM-0', CAST(user_id % 5 + 1 AS STRING)) AS camera_id,
  CASE event_type WHEN 'error' THEN 'RECONNECTING' WHEN 'signup' THEN 'RECONNECTING' WHEN 'click' THEN 'OFFLINE' ELSE 'ONLINE' END AS state,
  SUM(CASE WHEN value > 100 THEN 200 WHEN value > 60 THEN 15 ELSE 4 END) OVER (PARTITION BY user_id % 5 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at_s
 FROM events""",
    "fx_alert": """
SELECT e.event_id, e.stream_ms, CAST(floor(e.stream_ms / 1000) AS BIGINT) AS at_s, e.camera_id, e.track_id, e.label,
  CASE WHEN e.value > 150 THEN 'CAMERA TAMPERING' ELSE 'VIRTUAL FENCE INTRUSION' END AS event_type_name,
  CAST(least(100, floor(e.value)) AS INT) AS score,
  CASE WHEN floor(e.value) >= 90 THEN 'CRITICAL' WHEN floor(e.value) >= 65 THEN 'HIGH' WHEN floor(e.value) >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN e.track_id % 6 = 1 THEN p.true_plate END AS plate
 FROM fx_obs e LEFT JOIN fx_plate p ON e.track_id = p.track_id WHERE e.k % 4 = 0""",
    "fx_cam": """
SELECT concat('CAM-', lpad(CAST(s_suppkey AS STRING),3,'0')) AS camera_id, 28.60 + (s_suppkey % 10) * 0.001 AS lat, 77.20 + floor(s_suppkey / 10) * 0.001 AS lon,
  CASE WHEN s_suppkey % 4 <> 0 THEN CAST((s_suppkey * 37) % 360 AS DOUBLE) END AS bearing, CASE WHEN s_suppkey % 5 <> 0 THEN CAST(60 + s_suppkey % 31 AS DOUBLE) END AS fov FROM supplier WHERE s_suppkey % 11 <> 0""",
    "fx_sight": """
SELECT vec_id, concat('CAM-0', CAST(vec_id % 5 + 1 AS STRING)) AS camera_id, vec_id AS track_id, vec_id * 2 AS first_s, vec_id * 2 + vec_id % 7 AS last_s, embedding AS raw_vec, label AS cluster FROM embeddings""",
}
BASE = ("events", "embeddings", "supplier")
#: Observations a task sorts at most. Shuffled they take a tenth of their size in memory, so adaptive execution would give a task too many.
ROWS = 250_000


def needed(sql: str) -> list[str]:
    """Names of the views that sql uses, directly or not, in order."""
    use: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if name not in use and re.search(rf"\b{name}\b", text):
                use.add(name)
                todo.append(VIEWS[name])
    return [n for n in VIEWS if n in use]


def ctes(sql: str) -> str:
    """The WITH list of the views that sql uses."""
    return ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed(sql))


def by_track(events: DataFrame, rows: int = ROWS) -> DataFrame:
    """events dealt out by track, as the view of observations and all windows on it need them, into parts of about `rows` rows: one
    shuffle, as without it. Few events are left to adaptive execution."""
    parts = -(-events.count() // rows)
    return events.repartition(parts, "user_id") if parts > events.sparkSession.sparkContext.defaultParallelism else events


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived views over the tables in sf_dir."""
    sql = f"WITH {ctes(name)} SELECT * FROM {name}"
    for t in BASE:
        if re.search(rf"\b{t}\b", sql):
            table = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            if t == "events" and "fx_obs" in needed(name):
                table = by_track(table)
            table.createOrReplaceTempView(t)
    return spark.sql(sql)
