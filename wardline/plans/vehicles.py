"""Queries over plate reads, vehicles, camera links, the hash chain and the site."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from wardline.functions import geometry as G
from wardline.functions import plates as P
from wardline.functions import text as X
from wardline.operators import integrity as I
from wardline.operators import links as L
from wardline.operators import plates as V
from wardline.operators import site as S
from wardline.plans.fixtures import view
from wardline.plans.tracks import r6, sql

FENCES = [("SECTOR-7", ((28.600, 77.200), (28.600, 77.2045), (28.6055, 77.2045), (28.6055, 77.200))), ("GATE", ((28.6035, 77.2025), (28.6095, 77.2025), (28.6065, 77.2085)))]


def reads(spark, sf_dir):
    """Sharp, sure, plausible reads; plate is the tidy text as read."""
    o = view(spark, sf_dir, "fx_ocr").withColumns({"plate": P.clean(F.col("raw")), "confidence": F.col("ocr_conf_pct") / 100, "at_s": F.floor(F.col("stream_ms") / 1000)})
    return o.where(P.plausible(F.col("plate")) & (F.col("sharpness") >= 45) & (F.col("confidence") >= 0.12))


def attempts(spark, sf_dir):
    """Every read with its confidence and time."""
    return view(spark, sf_dir, "fx_ocr").withColumns({"confidence": F.col("ocr_conf_pct") / 100, "at_s": F.floor(F.col("stream_ms") / 1000)})


def accepted(spark, sf_dir):
    """Sharp, sure reads of a valid number; plate is that number, with confused characters repaired."""
    return V.accept(attempts(spark, sf_dir))


def plate_clean(spark, sf_dir):
    """Every raw read tidied, repaired, displayed."""
    o = P.normalised(view(spark, sf_dir, "fx_ocr"), "raw")
    n = F.col("plate")
    return o.select("event_id", P.clean(F.col("raw")).alias("tidy"), "plate", P.state_of(n).alias("state"), P.display(n).alias("display"))


def plate_fragments(spark, sf_dir):
    """Two-line plates: candidates of each observation's fragments."""
    o = view(spark, sf_dir, "fx_ocr")
    half = lambda i, text, top: F.struct(text.alias("text"), (F.col("ocr_conf_pct") / 100 - i / 100).alias("confidence"), F.lit(top).alias("top"), F.lit(top + 20).alias("bottom"), F.lit(i * 10).alias("left"))
    parts = F.array(half(0, F.substring("raw", 1, 4), 0), half(1, F.substring("raw", 5, 20), 30))
    f = o.select(F.col("event_id").alias("image"), F.explode(parts).alias("p")).select("image", "p.*")
    return V.fragments(f)


def plate_consensus(spark, sf_dir, reads=accepted):
    return V.consensus(reads(spark, sf_dir), ["camera_id", "track_id"], "plate", "k")


def plate_unconfirmed(spark, sf_dir, reads=accepted):
    r = reads(spark, sf_dir)
    return V.unconfirmed(r, V.consensus(r, ["camera_id", "track_id"], "plate", "k", 40), ["camera_id", "track_id"], "plate")


def plate_to_vehicle(spark, sf_dir):
    """Plate boxes in the vehicle boxes of their frame."""
    o = view(spark, sf_dir, "fx_obs").withColumn("frame", F.floor(F.col("event_id") / 40))
    half = F.floor(F.col("bh") / 2)
    veh = o.select("camera_id", "frame", F.col("event_id").alias("vehicle_id"), (F.col("fx") - half).alias("vx1"), (F.col("fy") - F.col("bh")).alias("vy1"), (F.col("fx") + half).alias("vx2"), F.col("fy").alias("vy2"))
    box = o.where("event_id % 2 = 0").select("camera_id", "frame", F.col("event_id").alias("box_id"), (F.col("conf_pct") / 100).alias("confidence"), (F.col("fx") - 20).alias("x1"), (F.col("fy") - 30).alias("y1"), (F.col("fx") + 30).alias("x2"), (F.col("fy") - 18).alias("y2"))
    ok = P.plate_shaped(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(150))
    return V.in_vehicle(box.where(ok), veh)


def fleet_plates(spark, sf_dir, reads=accepted):
    r = reads(spark, sf_dir).withColumn("camera_id", F.concat(F.lit("CAM-0"), (F.col("event_id") % 5 + 1).cast("string")))
    return V.fleet(r).withColumn("cameras", F.array_join("cameras", ","))


def registry_check(spark, sf_dir, reads=accepted):
    """The first plate of each track against the registry."""
    seen = reads(spark, sf_dir).groupBy("camera_id", "track_id").agg(F.min_by("plate", "k").alias("plate"), F.min_by("label", "k").alias("label"))
    return V.check_registry(seen, view(spark, sf_dir, "fx_registry")).select("camera_id", "track_id", "plate", "known", "flagged", "mismatch", "behaviour", "points", "detail")


def _sightings(spark, sf_dir):
    o = view(spark, sf_dir, "fx_ocr").withColumn("plate", P.clean(F.col("raw"))).withColumn("confidence", F.col("ocr_conf_pct") / 100)
    return o.withColumn("plate", F.when(P.plausible(F.col("plate")) & (F.col("sharpness") >= 45), F.col("plate")))


def _accepted_sightings(spark, sf_dir):
    """All observations; plate is the valid number of those whose read is accepted."""
    o = P.normalised(view(spark, sf_dir, "fx_ocr").withColumn("confidence", F.col("ocr_conf_pct") / 100), "raw")
    return o.withColumn("plate", F.when(V.sure(F.col("confidence"), F.col("sharpness")), F.col("plate")))


def vehicle_passes(spark, sf_dir, sightings=_accepted_sightings):
    p = V.passes(sightings(spark, sf_dir))
    return p.select("camera_id", "track_id", "pass_no", F.col("first_ms").cast("long").alias("first_ms"), F.col("last_ms").cast("long").alias("last_ms"), "frames", "plate", "confidence", "crop_event")


def pass_log(spark, sf_dir):
    """The pass log's rows."""
    p = V.pass_log(V.passes(_accepted_sightings(spark, sf_dir)), F.timestamp_seconds(F.lit(86_400)))
    return p.select("camera_id", "track_id", F.unix_seconds("at").alias("at_s"), "vehicle", "plate", "plate_read", "seconds_in_view", "frames", "crop")


def pass_suppression(spark, sf_dir, sightings=_accepted_sightings):
    s = V.suppress(V.passes(sightings(spark, sf_dir)))
    return s.select("pass_key", "camera_id", "track_id", F.col("last_ms").cast("long").alias("last_ms"), "frames")


def read_sampling(spark, sf_dir, reads=accepted):
    r = reads(spark, sf_dir)
    return V.sample_reads(r, "veh_w", "veh_area", "k", "plate", ["camera_id", "track_id"]).select("camera_id", "track_id", "event_id", F.col("k").cast("long").alias("k"))


def link_changes(spark, sf_dir):
    return L.changes(view(spark, sf_dir, "fx_link")).select("event_id", "camera_id", "state", F.col("at_s").cast("long").alias("at_s"))


def link_outages(spark, sf_dir):
    o = L.outages(link_changes(spark, sf_dir))
    return o


def link_drops(spark, sf_dir):
    return L.drops(L.outages(link_changes(spark, sf_dir))).select("camera_id", "down_s", "recent")


def camera_integrity(spark, sf_dir):
    return L.findings(link_changes(spark, sf_dir))


def _chain(spark, sf_dir):
    a = view(spark, sf_dir, "fx_alert")
    return I.append(a.select("camera_id", "event_id", F.col("event_id").cast("string").alias("event"), F.col("at_s").cast("string").alias("ts"), F.concat_ws("|", "event_type_name", F.col("score").cast("string"), "severity").alias("payload")), ["camera_id"], "event_id")


def chain_verify_days(spark, sf_dir):
    """Breaks in a log chained by camera and day, of which a row in fifty was changed and another removed."""
    a = view(spark, sf_dir, "fx_alert").select("camera_id", F.floor(F.col("at_s") / 600).cast("long").alias("day"), F.col("event_id").alias("n"), F.col("event_id").cast("string").alias("event"), F.col("at_s").cast("string").alias("ts"), F.col("score").cast("string").alias("payload"))
    linked, heads = I.append_days(a, ["camera_id"], "day", "n")
    bad = linked.where("n % 50 <> 12").withColumn("payload", F.when(F.col("n") % 50 == 8, F.concat("payload", F.lit("0"))).otherwise(F.col("payload")))
    return I.verify_days(bad, heads, ["camera_id"], "day")


def chain_verify(spark, sf_dir):
    """Breaks of a chain in which some rows were edited and others removed."""
    c = _chain(spark, sf_dir).where("event_id % 31 <> 7").withColumn("payload", F.when(F.col("event_id") % 53 == 0, "edited").otherwise(F.col("payload")))
    return I.verify(c, ["camera_id"])


def chain_heads(spark, sf_dir):
    c = _chain(spark, sf_dir)
    return c.groupBy("camera_id").agg(F.max("seq").cast("long").alias("events"), F.max_by("hash", "seq").alias("head"))


def camera_nearest(spark, sf_dir):
    return S.nearest(view(spark, sf_dir, "fx_cam")).select("camera_id", F.round("metres", 3).alias("metres"), "nth")


def coverage_wedge(spark, sf_dir):
    c = view(spark, sf_dir, "fx_cam")
    w = c.select("camera_id", F.posexplode(S.wedge(F.col("lat").cast("double"), F.col("lon").cast("double"), F.col("bearing"), F.col("fov"))).alias("i", "p"))
    return w.select("camera_id", "i", r6(F.col("p.lat")).alias("lat"), r6(F.col("p.lon")).alias("lon"))


def camera_geofences(spark, sf_dir):
    c = view(spark, sf_dir, "fx_cam")
    return c.select("camera_id", F.explode(S.fences_of(F.col("lat").cast("double"), F.col("lon").cast("double"), FENCES)).alias("area"))


def camera_unplaced(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("CAM-"), F.lpad(F.col("s_suppkey").cast("string"), 3, "0")).alias("camera_id"))
    return s.join(view(spark, sf_dir, "fx_cam"), "camera_id", "left_anti")


def site_map(spark, sf_dir):
    c = view(spark, sf_dir, "fx_cam").withColumns({"lat": F.col("lat").cast("double"), "lon": F.col("lon").cast("double")})
    m = S.site_map(c, FENCES).withColumn("fine", S.valid_place(F.col("lat"), F.col("lon"), F.col("bearing"), F.col("fov")))
    return m.select("camera_id", "located", "all_round", "half_surveyed", "fine", F.size("view").alias("view_points"), F.array_join("areas", ",").alias("areas"))


def range_height(spark, sf_dir):
    """Pixel height of a person at the distance of each camera's nearest neighbour."""
    n = S.nearest(view(spark, sf_dir, "fx_cam"), 1)
    return n.select("camera_id", F.round(G.person_px(F.col("metres"), 540, 45.0), 3).alias("person_px"))


def url_redact(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", X.redact(F.concat(F.col("url"), F.when(F.col("url").contains("?"), "&token=abc").otherwise(""))).alias("url"))


QUERIES = {f.__name__: f for f in (pass_log, chain_verify_days, plate_clean, plate_fragments, plate_consensus, plate_unconfirmed, plate_to_vehicle, fleet_plates, registry_check, vehicle_passes, pass_suppression, read_sampling, link_changes, link_outages, link_drops, camera_integrity, chain_verify, chain_heads, camera_nearest, coverage_wedge, camera_geofences, camera_unplaced, site_map, range_height, url_redact)}
# The same over plates as read: tidied, not repaired.
QUERIES |= {f"{f.__name__}_as_read": partial(f, reads=reads) for f in (plate_consensus, plate_unconfirmed, fleet_plates, registry_check, read_sampling)}
QUERIES |= {f"{f.__name__}_as_read": partial(f, sightings=_sightings) for f in (vehicle_passes, pass_suppression)}


def _near(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) = length({b}) THEN list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN {a}[i] <> {b}[i] THEN 1 ELSE 0 END)) <= 3 ELSE abs(length({a}) - length({b})) <= 1 END"


_DIG, _LET = (lambda x, m=m: f"translate({x}, '{m[0]}', '{m[1]}')" for m in (P.TO_DIGIT, P.TO_LETTER))
_CODES = ", ".join(f"('{c}')" for c in P.STATES)
_LIKE = ", ".join(f"('{read}', '{real}')" for read, more in P.LOOKALIKE.items() for real in more if real.isalpha())
_TRY = lambda c: f"""SELECT t, {c}, s, CASE WHEN s <> '' THEN coalesce(CASE WHEN s IN (SELECT code FROM pl_st) THEN s END, (SELECT code FROM pl_fx WHERE bad = s)) || {c}[3:] END AS r FROM (SELECT DISTINCT t, {c}, regexp_extract({c}, '{P.STANDARD}', 1) AS s FROM n1)"""
_PICK = lambda i: f"CASE WHEN (t{i}.s IN (SELECT code FROM pl_st) OR regexp_matches(n1.c{i}, '{P.BHARAT}')) AND {_near('n1.t', f'n1.c{i}')} THEN n1.c{i} END, CASE WHEN {_near('n1.t', f't{i}.r')} THEN t{i}.r END"
#: nm: the reads with plate, the valid number that a read is close to.
NM = f"""pl_st AS (SELECT code FROM (VALUES {_CODES}) v(code)), pl_lk AS (SELECT read, real FROM (VALUES {_LIKE}) v(read, real)),
pl_fx AS (SELECT bad, min(code) AS code FROM (SELECT code, read || code[2] AS bad FROM pl_st JOIN pl_lk ON code[1] = real UNION SELECT code, code[1] || read FROM pl_st JOIN pl_lk ON code[2] = real) WHERE bad NOT IN (SELECT code FROM pl_st) GROUP BY bad HAVING count(*) = 1),
n0 AS (SELECT *, t[3:length(t) - 4] AS mid, length(regexp_extract({_DIG("t[3:length(t) - 4]")}, '^[0-9]{{0,2}}')) AS lead FROM (SELECT DISTINCT raw, regexp_replace(upper(coalesce(raw, '')), '[^A-Z0-9]', '', 'g') AS t FROM fx_ocr)),
n1 AS (SELECT raw, t, t AS c0, CASE WHEN length(t) >= 9 AND lead > 0 THEN {_LET("t[1:2]")} || {_DIG("mid[1:lead]")} || {_LET("mid[lead + 1:]")} || {_DIG("t[length(t) - 3:]")} END AS c1,
  CASE WHEN length(t) >= 9 AND {_LET("t[3:4]")} = 'BH' THEN {_DIG("t[1:2]")} || 'BH' || {_DIG("t[5:8]")} || {_LET("t[9:]")} END AS c2 FROM n0),
n2 AS (SELECT n1.raw, n1.t, CASE WHEN length(n1.t) BETWEEN 8 AND 11 THEN coalesce({_PICK(0)}, {_PICK(1)}, {_PICK(2)}) END AS plate FROM n1
  JOIN ({_TRY("c0")}) t0 ON t0.t = n1.t LEFT JOIN ({_TRY("c1")}) t1 ON t1.t = n1.t LEFT JOIN ({_TRY("c2")}) t2 ON t2.t = n1.t),
nm AS (SELECT o.*, n2.t AS tidy, n2.plate, ocr_conf_pct / 100.0::DOUBLE AS confidence, CAST(floor(stream_ms / 1000) AS BIGINT) AS at_s FROM fx_ocr o JOIN n2 ON o.raw IS NOT DISTINCT FROM n2.raw)"""
RD_REPAIRED = f"{NM},\nrd AS (SELECT * FROM nm WHERE plate IS NOT NULL AND sharpness >= 45 AND ocr_conf_pct >= 12)"
SI_REPAIRED = f"{NM},\nsi AS (SELECT * REPLACE (CASE WHEN sharpness >= 45 AND ocr_conf_pct >= 12 THEN plate END AS plate) FROM nm)"
RD = """rd AS (SELECT *, upper(replace(raw, ' ', '')) AS plate, ocr_conf_pct / 100.0::DOUBLE AS confidence, CAST(floor(stream_ms / 1000) AS BIGINT) AS at_s FROM fx_ocr WHERE raw <> 'TAXI' AND sharpness >= 45 AND ocr_conf_pct >= 12)"""


def _cons(n: int) -> str:
    return f"""vt AS (SELECT camera_id, track_id, plate, count(*) AS n, min(k) AS fk FROM rd GROUP BY ALL), ln AS (SELECT camera_id, track_id, length(plate) AS len, sum(n) AS reads, min(fk) AS fk FROM vt GROUP BY ALL),
bs AS (SELECT camera_id, track_id, arg_max(len, (reads, -fk)) AS len, arg_max(reads, (reads, -fk)) AS reads FROM ln GROUP BY ALL),
ch AS (SELECT vt.camera_id, vt.track_id, p, plate[p] AS c, sum(n) AS n FROM vt JOIN bs USING (camera_id, track_id), (SELECT unnest(range(1, 14)) AS p) WHERE length(plate) = len AND p <= len AND reads >= {n} GROUP BY ALL),
tp AS (SELECT camera_id, track_id, p, arg_max(c, (n, c)) AS c, max(n) AS top, count(*) FILTER (n = mx) AS ties FROM (SELECT *, max(n) OVER (PARTITION BY camera_id, track_id, p) AS mx FROM ch) GROUP BY ALL),
mg AS (SELECT camera_id, track_id, max(ties) AS ties, string_agg(c, '' ORDER BY p) AS text FROM tp GROUP BY ALL),
cn AS (SELECT bs.camera_id, bs.track_id, CASE WHEN ties = 1 THEN text END AS consensus, CAST(reads AS BIGINT) AS reads FROM bs LEFT JOIN mg USING (camera_id, track_id))"""


SI = "si AS (SELECT *, CASE WHEN raw <> 'TAXI' AND sharpness >= 45 THEN upper(replace(raw, ' ', '')) END AS plate, ocr_conf_pct / 100.0::DOUBLE AS confidence FROM fx_ocr)"
PA = """pn AS (SELECT *, sum(nw) OVER (PARTITION BY camera_id, track_id ORDER BY k) AS pass_no FROM (SELECT *, CASE WHEN stream_ms - lag(stream_ms) OVER (PARTITION BY camera_id, track_id ORDER BY k) <= 2000 THEN 0 ELSE 1 END AS nw FROM si)),
pa AS (SELECT camera_id, track_id, CAST(pass_no AS BIGINT) AS pass_no, CAST(min(stream_ms) AS BIGINT) AS first_ms, CAST(max(stream_ms) AS BIGINT) AS last_ms, count(*) AS frames, arg_max(plate, (confidence, k)) FILTER (plate IS NOT NULL) AS plate, max(confidence) FILTER (plate IS NOT NULL) AS confidence, arg_max(event_id, (sharpness, -k)) AS crop_event FROM pn GROUP BY 1, 2, 3)"""
CH = "lk AS (SELECT event_id, camera_id, state, CAST(at_s AS BIGINT) AS at_s FROM (SELECT *, lag(state) OVER (PARTITION BY camera_id ORDER BY event_id) AS p FROM fx_link) WHERE state IS DISTINCT FROM p)"
OUT = """ou AS (SELECT camera_id, down_s, up_s, up_s - down_s AS seconds, ended_as FROM (SELECT camera_id, up, min(at_s) FILTER (state = 'RECONNECTING') AS down_s, max(at_s) FILTER (state <> 'RECONNECTING') AS up_s, max(state) FILTER (state <> 'RECONNECTING') AS ended_as
  FROM (SELECT *, coalesce(sum(CASE WHEN state <> 'RECONNECTING' THEN 1 ELSE 0 END) OVER (PARTITION BY camera_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS up FROM lk) GROUP BY 1, 2) WHERE down_s IS NOT NULL)"""
FIND = """ln AS (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY event_id) AS rn FROM lk),
fs(camera_id, rn, event_id, at_s, down, drops, ll, lo, lr, f1, f2, f3) AS (
 SELECT DISTINCT camera_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS BIGINT[]), CAST(-1000000 AS BIGINT), CAST(-1000000 AS BIGINT), CAST(-1000000 AS BIGINT), false, false, false FROM ln
 UNION ALL SELECT camera_id, rn, event_id, at_s, down2, drops2, CASE WHEN g1 THEN at_s ELSE ll END, CASE WHEN g2 THEN at_s ELSE lo END, CASE WHEN g3 THEN at_s ELSE lr END, g1, g2, g3 FROM (
  SELECT *, chk AND len(drops2) >= 3 AND at_s - lr >= 60 AS g3 FROM (
   SELECT *, CASE WHEN chk THEN list_filter(drops1, lambda t: at_s - t <= 300) ELSE drops1 END AS drops2 FROM (
    SELECT n.camera_id, n.rn, n.event_id, n.at_s, f.ll, f.lo, f.lr,
     CASE n.state WHEN 'RECONNECTING' THEN coalesce(f.down, n.at_s) WHEN 'ONLINE' THEN NULL ELSE CASE WHEN n.at_s - f.lo >= 60 THEN NULL ELSE f.down END END AS down2,
     CASE WHEN n.state = 'RECONNECTING' AND f.down IS NULL THEN list_append(f.drops, n.at_s) ELSE f.drops END AS drops1,
     n.state = 'ONLINE' AND f.down IS NOT NULL AND n.at_s - f.down >= 10 AND n.at_s - f.ll >= 60 AS g1, n.state = 'OFFLINE' AND n.at_s - f.lo >= 60 AS g2,
     CASE n.state WHEN 'RECONNECTING' THEN true WHEN 'ONLINE' THEN f.down IS NOT NULL ELSE n.at_s - f.lo >= 60 END AS chk
    FROM fs f JOIN ln n ON n.camera_id = f.camera_id AND n.rn = f.rn + 1))))"""
CHAIN = """al AS (SELECT camera_id, event_id, CAST(event_id AS VARCHAR) AS event, CAST(at_s AS VARCHAR) AS ts, event_type_name || '|' || score || '|' || severity AS payload, row_number() OVER (PARTITION BY camera_id ORDER BY event_id) AS rn FROM fx_alert),
hc AS (SELECT camera_id, rn, event_id, event, ts, payload, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || chr(31) || event || chr(31) || ts || chr(31) || payload) AS hash FROM al WHERE rn = 1
  UNION ALL SELECT a.camera_id, a.rn, a.event_id, a.event, a.ts, a.payload, h.hash, sha256(h.hash || chr(31) || a.event || chr(31) || a.ts || chr(31) || a.payload) FROM hc h JOIN al a ON a.camera_id = h.camera_id AND a.rn = h.rn + 1)"""
_HAV = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
NEAR = f"cm AS (SELECT camera_id, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, bearing, fov FROM fx_cam), nr AS (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY metres, other_id) AS nth FROM (SELECT a.camera_id, b.camera_id AS other_id, {_HAV} AS metres FROM cm a JOIN cm b ON a.camera_id <> b.camera_id))"
_FX = "(VALUES " + ", ".join(f"('{n}', {o}, {float(a[0])!r}::DOUBLE, {float(a[1])!r}::DOUBLE, {float(b[0])!r}::DOUBLE, {float(b[1])!r}::DOUBLE)" for o, (n, p) in enumerate(FENCES) for a, b in zip(p, (*p[1:], p[0]), strict=True)) + ") e(area, o, y1, x1, y2, x2)"
AREA = f"ar AS (SELECT camera_id, area, o FROM cm, {_FX} GROUP BY ALL HAVING sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) / (y2 - y1) * (x2 - x1) THEN 1 ELSE 0 END) % 2 = 1)"
_rec = lambda s: s.replace("WITH ", "WITH RECURSIVE ", 1)
ORACLE = {
    "plate_consensus": sql("SELECT * FROM cn", RD, _cons(2)),
    "plate_unconfirmed": sql("SELECT camera_id, track_id, plate, n, CAST(nth AS INT) AS nth FROM (SELECT vt.*, row_number() OVER (PARTITION BY camera_id, track_id ORDER BY n DESC, plate) AS nth FROM vt JOIN cn USING (camera_id, track_id) WHERE consensus IS NULL) WHERE nth <= 3", RD, _cons(40)),
    "plate_to_vehicle": sql("""SELECT camera_id, frame, v AS vehicle_id, arg_max(b, (confidence, -b)) AS box_id, max(confidence) AS confidence FROM (SELECT a.camera_id, a.frame, v.event_id AS v, a.event_id AS b, a.conf_pct / 100.0::DOUBLE AS confidence FROM fo a JOIN fo v ON a.camera_id = v.camera_id AND a.frame = v.frame
  WHERE a.event_id % 2 = 0 AND a.fx + 5 BETWEEN v.fx - floor(v.bh / 2) AND v.fx + floor(v.bh / 2) AND a.fy - 24 BETWEEN v.fy - v.bh AND v.fy) GROUP BY 1, 2, 3""", "fo AS (SELECT *, CAST(floor(event_id / 40) AS BIGINT) AS frame FROM fx_obs)"),
    "fleet_plates": sql("""SELECT plate, sum(n)::BIGINT AS reads, max(c) AS confidence, max(last) AS last_s, string_agg(camera, ',' ORDER BY f) AS cameras, arg_min(camera, f) AS first_read_by FROM (SELECT plate, 'CAM-0' || (event_id % 5 + 1) AS camera, count(*) AS n, max(confidence) AS c, max(at_s) AS last, min((at_s, event_id)) AS f FROM rd GROUP BY 1, 2) GROUP BY 1""", RD),
    "registry_check": sql("""SELECT camera_id, track_id, s.plate, r.status IS NOT NULL AS known, coalesce(r.status = 'STOLEN', false) AS flagged, coalesce(reg <> s.label, false) AS mismatch,
  CASE WHEN r.status = 'STOLEN' THEN 'WATCHLISTED VEHICLE' WHEN reg <> s.label THEN 'PLATE MISMATCH' WHEN r.status IS NULL THEN 'UNREGISTERED PLATE' END AS behaviour, CASE WHEN r.status = 'STOLEN' THEN 45 WHEN reg <> s.label THEN 35 WHEN r.status IS NULL THEN 5 ELSE 0 END AS points,
  CASE WHEN r.status IS NULL THEN 'not in the registry' WHEN r.status = 'STOLEN' THEN 'registry status STOLEN' WHEN reg <> s.label THEN 'plate is registered to a ' || lower(reg) || ', camera sees a ' || lower(s.label) WHEN reg IS NULL THEN 'registered class ''' || vehicle_class || ''' not recognised' ELSE 'matches registration (' || lower(reg) || ')' END AS detail
  FROM (SELECT camera_id, track_id, arg_min(plate, k) AS plate, arg_min(label, k) AS label FROM rd GROUP BY 1, 2) s LEFT JOIN (SELECT *, CASE vehicle_class WHEN 'Motor Car' THEN 'CAR' WHEN 'Goods Carrier' THEN 'TRUCK' END AS reg FROM fx_registry) r ON r.plate = s.plate""", RD),
    "vehicle_passes": sql("SELECT * FROM pa", SI, PA),
    "pass_suppression": _rec(sql("SELECT pass_key, camera_id, track_id, last_ms, frames FROM pk WHERE (pass_key, rn) IN (SELECT (pass_key, rn) FROM pf WHERE fire)", SI, PA, """pk AS (SELECT *, row_number() OVER (PARTITION BY pass_key ORDER BY last_ms, first_ms) AS rn FROM (SELECT *, coalesce(plate, camera_id || '#' || track_id) AS pass_key FROM pa)),
pf AS (SELECT pass_key, rn, last_ms AS la, true AS fire FROM pk WHERE rn = 1 UNION ALL SELECT p.pass_key, p.rn, CASE WHEN p.last_ms - la >= 10000 THEN p.last_ms ELSE la END, p.last_ms - la >= 10000 FROM pf f JOIN pk p ON p.pass_key = f.pass_key AND p.rn = f.rn + 1)""")),
    "read_sampling": _rec(sql("SELECT camera_id, track_id, event_id, k FROM sf WHERE ok", RD, """sr AS (SELECT *, row_number() OVER (PARTITION BY camera_id, track_id ORDER BY k) AS rn FROM rd WHERE veh_w >= 180),
sf AS (SELECT camera_id, track_id, rn, event_id, k, true AS ok, k AS last, CAST(veh_area AS DOUBLE) AS best, [plate] AS kept FROM sr WHERE rn = 1 UNION ALL SELECT camera_id, track_id, rn, event_id, k, ok, CASE WHEN ok THEN k ELSE last END, CASE WHEN ok THEN greatest(best, veh_area) ELSE best END, CASE WHEN ok THEN list_append(kept, plate) ELSE kept END FROM (
  SELECT s.*, f.last, f.best, f.kept, len(f.kept) < 12 AND s.k - f.last >= 10 AND (list_max(list_transform(f.kept, lambda y: len(list_filter(f.kept, lambda z: z = y)))) < 3 OR s.veh_area >= 1.15::DOUBLE * f.best) AS ok FROM sf f JOIN sr s ON s.camera_id = f.camera_id AND s.track_id = f.track_id AND s.rn = f.rn + 1))""")),
    "link_changes": sql("SELECT * FROM lk", CH),
    "link_outages": sql("SELECT * FROM ou", CH, OUT),
    "link_drops": sql("SELECT camera_id, down_s, count(*) OVER (PARTITION BY camera_id ORDER BY down_s RANGE BETWEEN 300 PRECEDING AND CURRENT ROW) AS recent FROM ou", CH, OUT),
    "camera_integrity": _rec(sql("SELECT camera_id, event_id, at_s, 'CAMERA LINK LOST' AS finding, 40 AS points FROM fs WHERE f1 UNION ALL SELECT camera_id, event_id, at_s, 'CAMERA OFFLINE', 55 FROM fs WHERE f2 UNION ALL SELECT camera_id, event_id, at_s, 'REPEATED LINK LOSS', 15 FROM fs WHERE f3", CH, FIND)),
    "chain_verify": _rec(sql("""SELECT camera_id, event, b AS "break" FROM (SELECT camera_id, event, unnest(list_filter([CASE WHEN prev_hash <> pv THEN 'previous changed or removed' END, CASE WHEN sha256(prev_hash || chr(31) || event || chr(31) || ts || chr(31) || payload) <> hash THEN 'contents changed' END], lambda x: x IS NOT NULL)) AS b
  FROM (SELECT * REPLACE (CASE WHEN event_id % 53 = 0 THEN 'edited' ELSE payload END AS payload), coalesce(lag(hash) OVER (PARTITION BY camera_id ORDER BY event_id), repeat('0', 64)) AS pv FROM hc WHERE event_id % 31 <> 7))""", CHAIN)),
    "chain_heads": _rec(sql("SELECT camera_id, max(rn) AS events, arg_max(hash, rn) AS head FROM hc GROUP BY 1", CHAIN)),
    "camera_nearest": sql("SELECT camera_id, round(metres, 3) AS metres, CAST(nth AS INT) AS nth FROM nr WHERE nth <= 3", NEAR),
    "range_height": sql("SELECT camera_id, round(540 * 1.7::DOUBLE / (2 * metres * tan(radians(45.0) / 2)), 3) AS person_px FROM nr WHERE nth = 1", NEAR),
    "coverage_wedge": sql("""SELECT camera_id, CAST(i AS INT) AS i, round(CASE WHEN i IN (0, 14) THEN lat ELSE la END, 6) + 0.0 AS lat, round(CASE WHEN i IN (0, 14) THEN lon ELSE fmod(lo + 540.0, 360.0) - 180.0 END, 6) + 0.0 AS lon FROM (SELECT *, degrees(q) AS la, degrees(radians(lon) + atan2(sin(b) * sin(d) * cos(p), cos(d) - sin(p) * sin(q))) AS lo
  FROM (SELECT *, asin(sin(p) * cos(d) + cos(p) * sin(d) * cos(b)) AS q FROM (SELECT *, radians(lat) AS p, radians(bearing - fov / 2 + fov * (i - 1) / 12) AS b, 60.0 / 6371008.8 AS d FROM cm, (SELECT unnest(range(0, 15)) AS i) WHERE bearing IS NOT NULL AND fov IS NOT NULL)))""", NEAR),
    "camera_geofences": sql("SELECT camera_id, area FROM ar", NEAR, AREA),
    "camera_unplaced": sql("SELECT 'CAM-' || lpad(CAST(s_suppkey AS VARCHAR), 3, '0') AS camera_id FROM supplier WHERE 'CAM-' || lpad(CAST(s_suppkey AS VARCHAR), 3, '0') NOT IN (SELECT camera_id FROM fx_cam)"),
    "site_map": sql("SELECT camera_id, true AS located, coalesce(fov >= 360, false) AS all_round, (bearing IS NULL) <> (fov IS NULL) AS half_surveyed, true AS fine, CAST(CASE WHEN bearing IS NULL OR fov IS NULL THEN 0 ELSE 15 END AS INT) AS view_points, coalesce(areas, '') AS areas FROM cm LEFT JOIN (SELECT camera_id, string_agg(area, ',' ORDER BY o) AS areas FROM ar GROUP BY 1) USING (camera_id)", NEAR, AREA),
    "url_redact": "SELECT page_id, CASE WHEN contains(url, '?') THEN regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '#') THEN regexp_extract(url, '#.*$') ELSE '' END || '&token=***' ELSE url END AS url FROM pages",
}
for _k in [k for k in ORACLE if f"{k}_as_read" in QUERIES]:
    ORACLE[f"{_k}_as_read"] = ORACLE[_k]
    ORACLE[_k] = ORACLE[_k].replace(RD, RD_REPAIRED).replace(SI, SI_REPAIRED)
ORACLE["plate_clean"] = sql(f"""SELECT event_id, tidy, plate, CASE WHEN plate[1:2] IN (SELECT code FROM pl_st) AND regexp_matches(plate, '{P.STANDARD}') THEN plate[1:2] END AS state,
  CASE WHEN regexp_matches(plate, '{P.STANDARD}') THEN trim(regexp_replace(regexp_replace(plate, '{P.STANDARD}', '\\1 \\2 \\3 \\4'), ' +', ' ', 'g')) ELSE plate END AS display FROM nm""", NM)
ORACLE["plate_fragments"] = r"""
SELECT image, CAST(row_number() OVER (PARTITION BY image ORDER BY length(text) NOT BETWEEN 8 AND 11, confidence DESC, text) AS INT) AS nth, text, confidence FROM (
  SELECT image, unnest([a, b, a || b]) AS text, unnest([c, c - 0.01::DOUBLE, c - 0.01::DOUBLE]) AS confidence FROM (
    SELECT event_id AS image, regexp_replace(upper(raw[1:4]), '[^A-Z0-9]', '', 'g') AS a, regexp_replace(upper(raw[5:24]), '[^A-Z0-9]', '', 'g') AS b, ocr_conf_pct / 100.0::DOUBLE AS c FROM fx_ocr))
WHERE length(text) BETWEEN 4 AND 13 AND regexp_matches(text, '[0-9]') AND regexp_matches(text, '[A-Z]')"""
ORACLE["plate_fragments"] = sql(ORACLE["plate_fragments"])
_PASSES = ORACLE["vehicle_passes"].rpartition("\nSELECT ")
ORACLE["pass_log"] = f"""{_PASSES[0]},
ps AS (SELECT {_PASSES[2]}),
lb AS (SELECT DISTINCT camera_id, track_id, label FROM fx_ocr)
SELECT camera_id, track_id, 86400 + CAST(floor(first_ms / 1000) AS BIGINT) AS at_s, label AS vehicle, plate, plate IS NOT NULL AS plate_read, round_even((last_ms - first_ms) / 1000.0::DOUBLE, 1) AS seconds_in_view, frames,
  'pass-' || camera_id || '-' || track_id AS crop FROM ps JOIN lb USING (camera_id, track_id)"""
ORACLE["chain_verify_days"] = sql("""SELECT camera_id, day, event, "break" FROM (
  SELECT camera_id, day, CAST(event_id AS VARCHAR) AS event, unnest(list_filter([CASE WHEN before % 50 = 12 THEN 'previous changed or removed' END, CASE WHEN event_id % 50 = 8 THEN 'contents changed' END], lambda x: x IS NOT NULL)) AS "break"
  FROM (SELECT camera_id, CAST(floor(at_s / 600) AS BIGINT) AS day, event_id, lag(event_id) OVER (PARTITION BY camera_id, floor(at_s / 600) ORDER BY event_id) AS before FROM fx_alert) WHERE event_id % 50 <> 12)
UNION ALL SELECT camera_id, CAST(floor(at_s / 600) AS BIGINT) AS day, NULL AS event, CASE WHEN count(*) = count(*) FILTER (event_id % 50 = 12) THEN 'day removed' ELSE 'day does not end as its head says' END AS "break"
  FROM fx_alert GROUP BY 1, 2 HAVING count(*) FILTER (event_id % 50 = 12) > 0""")
