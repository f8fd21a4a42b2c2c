"""Queries across cameras, over tracks of detections, and of evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wardline.functions import geometry as G
from wardline.functions import plates as P
from wardline.functions import vectors as X
from wardline.operators import crosscam as C
from wardline.operators import evaluate as E
from wardline.operators.risk import night
from wardline.plans.fixtures import view
from wardline.plans.tracks import r6, sql
from wardline.sources.footage import emitted, footage_seconds


def sightings(spark, sf_dir):
    s = view(spark, sf_dir, "fx_sight").withColumn("raw", X.histogram(F.col("raw_vec")))
    return s.withColumn("sum", X.total(F.col("raw"))).withColumn("hist", F.transform("raw", lambda x: x / F.col("sum"))).drop("raw", "sum")


def _handoff_sides(spark, sf_dir):
    s = sightings(spark, sf_dir)
    unread = s.where("vec_id % 3 <> 0").select(F.col("vec_id").alias("sighting_id"), "camera_id", F.col("first_s").alias("at_s"), "hist")
    reads = s.where("vec_id % 3 = 0").select(F.col("vec_id").alias("read_id"), "camera_id", F.col("first_s").alias("at_s"), F.concat(F.lit("PL"), F.col("vec_id").cast("string")).alias("plate"), "hist")
    return unread, reads


def handoff(spark, sf_dir):
    """Plates handed to sightings of other cameras."""
    h = C.handoff(*_handoff_sides(spark, sf_dir), similarity=0.66)
    return h.select("sighting_id", "plate", "read_by", F.col("at_s").cast("long").alias("at_s"), r6(F.col("similarity")).alias("similarity"), "inferred")


def _posts(spark, sf_dir):
    return sightings(spark, sf_dir).select(F.col("vec_id").alias("id"), (F.floor(F.col("vec_id") / 3) % 4).cast("long").alias("post"), "camera_id", "first_s", "last_s", "hist")


def subject_candidates(spark, sf_dir):
    c = C.subject_candidates(_posts(spark, sf_dir), similarity=0.66)
    return c.select("id", "id_2", F.col("gap_s").cast("long").alias("gap_s"), r6(F.col("similarity")).alias("similarity"))


def subjects(spark, sf_dir):
    """Subjects linked across the cameras of each post."""
    return C.subject_summary(C.link_subjects(_posts(spark, sf_dir), similarity=0.66))


def subjects_on_several(spark, sf_dir):
    return subjects(spark, sf_dir).where("size(cameras) > 1").groupBy("post").agg(F.count("*").alias("subjects"))


def _matches(spark, sf_dir):
    s = view(spark, sf_dir, "fx_sight")
    roster = s.where("vec_id < 40").select((F.col("vec_id") % 8).alias("person_id"), F.col("vec_id").alias("position"), F.col("raw_vec").alias("vec"))
    faces = s.where("vec_id >= 40").select(F.col("vec_id").alias("face_id"), F.col("raw_vec").alias("vec"))
    return C.match_roster(faces, roster, 0.15)


def roster_match(spark, sf_dir):
    return _matches(spark, sf_dir).select("face_id", "person_id", r6(F.col("similarity")).alias("similarity"))


def identity_settled(spark, sf_dir):
    m = _matches(spark, sf_dir).withColumn("track_id", F.floor(F.col("face_id") / 6))
    return C.settle_identity(m, "track_id").select("track_id", "person_id", "votes", C.identity_points(F.col("person_id"), F.col("votes")).alias("points"))


def face_to_person(spark, sf_dir):
    """Face boxes of enough width in the upper half of the person boxes of their frame."""
    from wardline.operators.plates import in_vehicle

    o = view(spark, sf_dir, "fx_obs").withColumn("frame", F.floor(F.col("event_id") / 40))
    half = F.floor(F.col("bh") / 2)
    person = o.where("label = 'PERSON'").select("camera_id", "frame", F.col("event_id").alias("vehicle_id"), (F.col("fx") - half).alias("vx1"), (F.col("fy") - F.col("bh")).alias("vy1"), (F.col("fx") + half).alias("vx2"), F.col("fy").alias("vy2"))
    face = o.select("camera_id", "frame", F.col("event_id").alias("box_id"), (F.col("bh") / 4).alias("confidence"), F.col("fx").alias("x1"), (F.col("fy") - F.col("bh")).alias("y1"), (F.col("fx") + F.floor(F.col("bh") / 4)).alias("x2"), (F.col("fy") - F.col("bh") + 40).alias("y2"))
    return in_vehicle(face.where("x2 - x1 >= 60"), person, True).select("camera_id", "frame", F.col("vehicle_id").alias("person"), F.col("box_id").alias("face"))


def track_assign(spark, sf_dir):
    """Tracks of the detections of each camera."""
    o = view(spark, sf_dir, "fx_obs").withColumn("frame", F.floor(F.col("event_id") / 20))
    half = F.floor(F.col("bh") / 4)
    d = o.select("camera_id", "frame", F.col("event_id").alias("det_id"), (F.col("conf_pct") / 100).alias("confidence"), (F.col("fx") - half).alias("x1"), (F.col("fy") - F.col("bh")).alias("y1"), (F.col("fx") + half).alias("x2"), F.col("fy").alias("y2"),
                 F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(i == F.col("track_id") % 8, 0.65).otherwise(0.05)).alias("hist"))
    return C.assign_tracks(d)


def _evaluated(spark, sf_dir):
    o = view(spark, sf_dir, "fx_ocr")
    g = P.clean(F.col("raw"))
    return o.select("event_id", "k", "track_id", "label", F.col("true_plate").alias("truth"), F.when(F.col("raw") == "TAXI", "").otherwise(g).alias("guess"), P.plausible(g).alias("valid"))


def read_accuracy(spark, sf_dir):
    return E.read_accuracy(_evaluated(spark, sf_dir), ["label"])


def consensus_metrics(spark, sf_dir):
    return E.consensus_metrics(_evaluated(spark, sf_dir).where("guess <> ''"), ["track_id"], "truth", "guess", "k")


def confusion_counts(spark, sf_dir):
    return E.confusions(_evaluated(spark, sf_dir))


def _hits(spark, sf_dir):
    o = view(spark, sf_dir, "fx_obs")
    return o.select((F.floor(F.col("bh") / 40) * 40).alias("size"), F.when(night(F.col("ts")), "night").otherwise("day").alias("condition"), (F.col("conf_pct") >= 60).alias("hit"))


def hit_rate(spark, sf_dir):
    return E.hit_rate(_hits(spark, sf_dir), ["day", "night"])


def smallest_size(spark, sf_dir):
    """Smallest size of which 99 % are hit, by condition; what is 320 px high is hit by day, 360 px by night."""
    h = _hits(spark, sf_dir).withColumn("hit", F.col("hit") | (F.col("size") >= F.when(F.col("condition") == "day", 320).otherwise(360)))
    return E.smallest_size(h)


def split_report(spark, sf_dir):
    o = E.split(view(spark, sf_dir, "fx_ocr"), "true_plate", 0.2)
    return o.groupBy("split").agg(F.count("*").alias("crops"), F.countDistinct("true_plate").alias("plates"), F.sum((F.col("sharpness") < 45).cast("int")).alias("blurred"))


def split_leakage(spark, sf_dir):
    """Plates in both splits: none."""
    return E.leakage(E.split(view(spark, sf_dir, "fx_ocr"), "true_plate", 0.2), "true_plate")


def split_outcomes(spark, sf_dir):
    """What becomes of annotated plates: a split, or the reason to skip them."""
    return E.split_outcomes(view(spark, sf_dir, "fx_ocr"), "true_plate", 0.2, "veh_w", 250, unreadable=F.col("raw") == "TAXI")


def split_leakage_found(spark, sf_dir):
    """Plates in both splits, where crops are split without regard to plates."""
    o = view(spark, sf_dir, "fx_ocr").withColumn("split", F.when(F.col("event_id") % 5 == 0, "validation").otherwise("train"))
    return E.leakage(o, "true_plate")


def identity_behaviours(spark, sf_dir):
    """Faces of tracks as behaviours: people of the roster, and others, for which points are set here."""
    m = _matches(spark, sf_dir).withColumn("track_id", F.floor(F.col("face_id") / 6))
    faces = m.groupBy("track_id").agg(F.count("*").alias("faces")).join(C.settle_identity(m, "track_id").select("track_id", "person_id"), "track_id", "left")
    people = faces.select(F.lit("CAM-01").alias("camera_id"), "track_id", F.lit(1).alias("from_k"), "person_id", F.lit(None).cast("string").alias("label"), F.lit("guard").alias("role"), F.lit(0.5).alias("similarity"))
    return C.identity_behaviours(people, unrecognised=12).select("track_id", "name", "points", "detail")


def stride_sample(spark, sf_dir):
    """Every third frame of a camera, at most 500, with its footage time."""
    o = view(spark, sf_dir, "fx_obs").withColumn("raw_index", F.row_number().over(Window.partitionBy("camera_id").orderBy("event_id")))
    o = o.withColumn("pts_s", F.when(F.col("event_id") % 4 == 0, F.col("stream_ms") / 1000))
    o = o.withColumn("at_s", footage_seconds(F.col("pts_s"), F.col("raw_index"), F.lit(25.0)))
    return emitted(o, 3, 500).select("camera_id", "event_id", F.col("index").cast("long").alias("index"), r6(F.col("at_s")).alias("at_s"))


def blend_drift(spark, sf_dir):
    """How like its neighbour's the blend of two descriptors remains."""
    s = sightings(spark, sf_dir).select("vec_id", "hist")
    n = s.select((F.col("vec_id") - 1).alias("vec_id"), F.col("hist").alias("next"))
    return s.join(n, "vec_id").select("vec_id", r6(X.intersection(X.blend(F.col("hist"), F.col("next")), F.col("hist"))).alias("kept"))


QUERIES = {f.__name__: f for f in (split_outcomes, split_leakage_found, identity_behaviours, handoff, subject_candidates, subjects, subjects_on_several, roster_match, identity_settled, face_to_person, track_assign, read_accuracy, consensus_metrics, confusion_counts, hit_rate, smallest_size, split_report, split_leakage, stride_sample, blend_drift)}

SI = """s0 AS (SELECT *, list_transform(raw_vec, lambda x: abs(CAST(x AS DOUBLE))) AS r FROM fx_sight), si AS (SELECT *, list_transform(r, lambda x: x / list_sum(r)) AS h FROM s0)"""
_SIM = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: least(z[1], z[2])))"
MT = """fm AS (SELECT face_id, arg_max(person, (sim, -pos)) AS p, max(sim) AS sim FROM (SELECT f.vec_id AS face_id, r.vec_id % 8 AS person, r.vec_id AS pos, list_cosine_similarity(CAST(f.raw_vec AS DOUBLE[]), CAST(r.raw_vec AS DOUBLE[])) AS sim FROM fx_sight f, fx_sight r WHERE f.vec_id >= 40 AND r.vec_id < 40) GROUP BY 1),
mt AS (SELECT face_id, CASE WHEN sim >= 0.15::DOUBLE THEN p END AS person_id, sim FROM fm)"""
EV = """ev AS (SELECT event_id, k, track_id, label, true_plate AS truth, CASE WHEN raw = 'TAXI' THEN '' ELSE upper(replace(raw, ' ', '')) END AS guess, raw <> 'TAXI' AS valid FROM fx_ocr)"""
_OV = lambda a, b: f"len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: {a}[i] = {b}[i]))"
_HOLD = "CAST('0x' || substr(sha1(true_plate), 1, 8) AS UBIGINT) / 4294967295.0::DOUBLE < 0.2::DOUBLE"
ORACLE = {
    "handoff": sql(f"""SELECT sighting_id, 'PL' || arg_min(rid, (rs, rid)) AS plate, arg_min(rc, (rs, rid)) AS read_by, CAST(arg_min(rs, (rs, rid)) AS BIGINT) AS at_s, round(arg_min(sim, (rs, rid)), 6) + 0.0 AS similarity, true AS inferred FROM (SELECT a.vec_id AS sighting_id, b.vec_id AS rid, b.camera_id AS rc, b.first_s AS rs, {_SIM('a.h', 'b.h')} AS sim
  FROM si a JOIN si b ON a.vec_id % 3 <> 0 AND b.vec_id % 3 = 0 AND a.camera_id <> b.camera_id AND b.first_s BETWEEN a.first_s AND a.first_s + 180) WHERE sim >= 0.66::DOUBLE GROUP BY 1""", SI),
    "subject_candidates": sql(f"""SELECT id, id_2, gap_s, round(sim, 6) + 0.0 AS similarity FROM (SELECT a.vec_id AS id, b.vec_id AS id_2, CAST(b.first_s - a.last_s AS BIGINT) AS gap_s, {_SIM('a.h', 'b.h')} AS sim FROM si a JOIN si b ON floor(a.vec_id / 3) % 4 = floor(b.vec_id / 3) % 4 AND a.camera_id <> b.camera_id AND b.first_s - a.last_s BETWEEN 1 AND 300) WHERE sim >= 0.66::DOUBLE""", SI),
    "roster_match": sql("SELECT face_id, person_id, round(sim, 6) + 0.0 AS similarity FROM mt", MT),
    "identity_settled": sql("""SELECT track_id, tp AS person_id, tv AS votes, -45 AS points FROM (SELECT track_id, arg_max(person_id, (votes, -f)) AS tp, arg_max(votes, (votes, -f)) AS tv, arg_max(person_id, b) AS bp FROM (SELECT CAST(floor(face_id / 6) AS BIGINT) AS track_id, person_id, count(*) AS votes, min(face_id) AS f, max((sim, -face_id)) AS b FROM mt WHERE person_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1) WHERE tv >= 2 AND tp = bp""", MT),
    "face_to_person": sql("""SELECT camera_id, frame, v AS person, arg_max(b, (c, -b)) AS face FROM (SELECT a.camera_id, a.frame, v.event_id AS v, a.event_id AS b, a.bh / 4.0::DOUBLE AS c FROM fo a JOIN fo v ON a.camera_id = v.camera_id AND a.frame = v.frame WHERE v.label = 'PERSON' AND floor(a.bh / 4) >= 60
  AND a.fx + floor(a.bh / 4) / 2 BETWEEN v.fx - floor(v.bh / 2) AND v.fx + floor(v.bh / 2) AND a.fy - a.bh + 20 BETWEEN v.fy - v.bh AND (v.fy - v.bh + v.fy) / 2) GROUP BY 1, 2, 3""", "fo AS (SELECT *, CAST(floor(event_id / 40) AS BIGINT) AS frame FROM fx_obs)"),
    "read_accuracy": sql(f"""SELECT label, count(*) AS reads, count(*) FILTER (truth = guess) AS exact, round(avg(greatest({_OV('truth', 'guess')}, {_OV('reverse(truth)', 'reverse(guess)')}) / greatest(length(truth), length(guess))), 6) AS characters, count(*) FILTER (valid) AS validated, count(*) FILTER (valid AND truth <> guess) AS validated_wrong, count(*) FILTER (guess = '') AS empty FROM ev GROUP BY 1""", EV),
    "consensus_metrics": sql("""SELECT *, reported - "right" AS wrong, groups - reported AS silent, round("right" / reported, 6) AS precision, round("right" / groups, 6) AS recall FROM (SELECT count(*) AS groups, count(text) AS reported, count(*) FILTER (text = truth) AS "right" FROM (SELECT g.track_id, g.truth, CASE WHEN m.ties = 1 THEN m.text END AS text FROM g5 g LEFT JOIN m5 m USING (track_id)))""", EV, """f5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY k) AS n FROM ev WHERE guess <> '') WHERE n <= 5),
g5 AS (SELECT track_id, count(*) AS n, min(truth) AS truth FROM f5 GROUP BY 1 HAVING count(*) >= 2), l5 AS (SELECT track_id, length(guess) AS len, count(*) AS n, min(k) AS fk FROM f5 GROUP BY 1, 2),
b5 AS (SELECT track_id, arg_max(len, (n, -fk)) AS len, arg_max(n, (n, -fk)) AS n FROM l5 GROUP BY 1), c5 AS (SELECT track_id, p, guess[p] AS c, count(*) AS n FROM f5 JOIN (SELECT track_id, len FROM b5 WHERE n >= 2) USING (track_id), (SELECT unnest(range(1, 14)) AS p) WHERE length(guess) = len AND p <= len GROUP BY ALL),
t5 AS (SELECT track_id, p, arg_max(c, (n, c)) AS c, count(*) FILTER (n = mx) AS ties FROM (SELECT *, max(n) OVER (PARTITION BY track_id, p) AS mx FROM c5) GROUP BY 1, 2), m5 AS (SELECT track_id, max(ties) AS ties, string_agg(c, '' ORDER BY p) AS text FROM t5 GROUP BY 1)"""),
    "confusion_counts": sql("SELECT was, read_as, count(*) AS n FROM (SELECT truth[i] AS was, guess[i] AS read_as FROM (SELECT truth, guess, unnest(range(1, length(truth) + 1)) AS i FROM ev WHERE length(truth) = length(guess))) WHERE was <> read_as GROUP BY 1, 2", EV),
    "hit_rate": sql("SELECT size, round(avg(h) FILTER (c = 'day'), 6) AS day, round(avg(h) FILTER (c = 'night'), 6) AS night FROM ht GROUP BY 1", "ht AS (SELECT CAST(floor(bh / 40) * 40 AS BIGINT) AS size, CASE WHEN hour(ts) >= 18 OR hour(ts) < 6 THEN 'night' ELSE 'day' END AS c, CASE WHEN conf_pct >= 60 THEN 1.0 ELSE 0.0 END AS h FROM fx_obs)"),
    "smallest_size": sql("SELECT c AS condition, min(CASE WHEN r >= 0.99 THEN size END) AS smallest FROM (SELECT c, size, avg(CASE WHEN size >= CASE c WHEN 'day' THEN 320 ELSE 360 END THEN 1.0 ELSE h END) AS r FROM ht GROUP BY 1, 2) GROUP BY 1", "ht AS (SELECT CAST(floor(bh / 40) * 40 AS BIGINT) AS size, CASE WHEN hour(ts) >= 18 OR hour(ts) < 6 THEN 'night' ELSE 'day' END AS c, CASE WHEN conf_pct >= 60 THEN 1.0 ELSE 0.0 END AS h FROM fx_obs)"),
    "split_report": sql(f"SELECT CASE WHEN {_HOLD} THEN 'validation' ELSE 'train' END AS split, count(*) AS crops, count(DISTINCT true_plate) AS plates, count(*) FILTER (sharpness < 45) AS blurred FROM fx_ocr GROUP BY 1"),
    "split_leakage": sql("SELECT true_plate FROM fx_ocr WHERE false"),
    "stride_sample": sql("SELECT camera_id, event_id, idx AS index, round(CASE WHEN pts > 0 THEN pts ELSE (i - 1) / 25.0::DOUBLE END, 6) + 0.0 AS at_s FROM (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY i) AS idx FROM ix WHERE (i - 1) % 3 = 0) WHERE idx <= 500", "ix AS (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY event_id) AS i, CASE WHEN event_id % 4 = 0 THEN stream_ms / 1000.0::DOUBLE END AS pts FROM fx_obs)"),
    "blend_drift": sql(f"SELECT a.vec_id, round({_SIM('list_transform(list_zip(a.h, b.h), lambda z: (z[1] * 0.7::DOUBLE + z[2] * 0.3::DOUBLE))', 'a.h')}, 6) + 0.0 AS kept FROM si a JOIN si b ON b.vec_id = a.vec_id + 1", SI),
}
_SETTLED = ORACLE["identity_settled"].rpartition("\nSELECT ")
ORACLE |= {
    "split_outcomes": sql(f"SELECT outcome, count(*) AS crops, count(DISTINCT CASE WHEN outcome = s THEN true_plate END) AS plates FROM (SELECT *, CASE WHEN raw = 'TAXI' THEN 'unreadable photograph' WHEN veh_w < 250 THEN 'too small' ELSE s END AS outcome FROM (SELECT *, CASE WHEN {_HOLD} THEN 'validation' ELSE 'train' END AS s FROM fx_ocr)) GROUP BY 1"),
    "split_leakage_found": sql("SELECT true_plate FROM fx_ocr GROUP BY 1 HAVING count(*) FILTER (event_id % 5 = 0) > 0 AND count(*) FILTER (event_id % 5 <> 0) > 0"),
    "identity_behaviours": f"""{_SETTLED[0]},
st AS (SELECT {_SETTLED[2]})
SELECT f.track_id, CASE WHEN person_id IS NULL THEN 'UNRECOGNISED PERSON' ELSE 'AUTHORISED PERSON' END AS name, CAST(CASE WHEN person_id IS NULL THEN 12 ELSE -45 END AS INT) AS points,
  CASE WHEN person_id IS NULL THEN 'face not on the roster for this post' ELSE 'recognised as ' || person_id || ', guard (0.50)' END AS detail
FROM (SELECT DISTINCT CAST(floor(face_id / 6) AS BIGINT) AS track_id FROM mt) f LEFT JOIN st USING (track_id)""",
}
