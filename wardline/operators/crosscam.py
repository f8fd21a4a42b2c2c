"""Linking what different cameras saw. Every link is inferred and says so."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import vectors as V
from wardline.operators import folds
from wardline.operators.lineage import cut


def near_in_time(left: DataFrame, right: DataFrame, at: str, other_at: str, window: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows at most `window` apart and equal in `by`: an equi-join on both and windows, each right row in its own and both
    neighbours."""
    a = left.withColumn("_w", F.floor(F.col(at) / window))
    b = right.withColumn("_w", F.explode(F.array(*[F.floor(F.col(other_at) / window) + d for d in (-1, 0, 1)])))
    return a.join(b, ["_w", *by]).where(F.abs(F.col(at) - F.col(other_at)) <= window).drop("_w")


def handoff(unread: DataFrame, reads: DataFrame, window: float = 180, similarity: float = 0.55, by: tuple[str, ...] = ()) -> DataFrame:
    """Unread sightings (sighting_id, camera_id, at_s, hist) credited with the plate of a read (read_id, camera_id, at_s, plate,
    hist) by another camera: of the first read, not before the sighting and at most `window` later, that looks enough like it.
    Rows (sighting_id, plate, read_by, at_s, similarity, inferred). Columns named in `by`, such as a site, must be equal, too: a fleet
    of many sites needs them, or all cameras meet in every window."""
    r = reads.select(*by, "read_id", "plate", F.col("camera_id").alias("read_by"), F.col("at_s").alias("read_s"), F.col("hist").alias("read_hist"))
    j = near_in_time(unread, r, "at_s", "read_s", window, by).where((F.col("read_by") != F.col("camera_id")) & (F.col("read_s") >= F.col("at_s")))
    j = j.withColumn("similarity", V.intersection(F.col("hist"), F.col("read_hist"))).where(F.col("similarity") >= similarity)
    first = F.struct("read_s", "read_id")
    got = j.groupBy("sighting_id").agg(F.min_by(F.struct("plate", "read_by", "read_s", "similarity"), first).alias("b"))
    return got.select("sighting_id", "b.plate", "b.read_by", F.col("b.read_s").alias("at_s"), "b.similarity", F.lit(True).alias("inferred"))


def subject_candidates(sightings: DataFrame, least=1, most=300, similarity: float = 0.72) -> DataFrame:
    """Pairs of sightings (id, post, camera_id, first_s, last_s, hist) of different cameras of a post: the second begins `least`
    to `most` seconds after the first ends and looks alike."""
    b = sightings.select("post", *[F.col(c).alias(f"{c}_2") for c in ("id", "camera_id", "first_s", "hist")])
    j = near_in_time(sightings, b, "last_s", "first_s_2", most, ("post",))
    gap = F.col("first_s_2") - F.col("last_s")
    j = j.where((F.col("camera_id") != F.col("camera_id_2")) & gap.between(least, most))
    return j.withColumn("similarity", V.intersection(F.col("hist"), F.col("hist_2"))).where(F.col("similarity") >= similarity).select("id", "id_2", gap.alias("gap_s"), "similarity")


def link_subjects(sightings: DataFrame, least=1, most=300, similarity: float = 0.72, ttl=1800) -> DataFrame:
    """Rows (post, id, subject_id, camera_id, first_s, last_s): sightings in order of time, each given to the most similar subject
    seen `least` to `most` seconds ago that its camera has not seen (the last of equals), else to a new one. A subject looks
    like a blend of its sightings. Sightings without a time have no subject. A post is cut where nothing seen before is within reach (`most`
    seconds); the pieces are folded in parallel, each in order, and subjects are counted through afterwards."""
    rows = sightings.select("post", "id", "camera_id", F.col("first_s").cast("long"), F.col("last_s").cast("long"), "hist").where("first_s is not null and last_s is not null")
    rows = folds.segments(rows, ["post"], "first_s", "last_s", most)
    got = cut(folds.in_order(rows, ["post", "segment_"], ["first_s", "id"], linked(least, most, similarity, ttl, ("segment_",)), LINKED.replace("subject_id string", "subject bigint") + ", segment_ bigint"))
    got = folds.numbered(got, ["post"], "subject")
    return got.select("post", "id", subject_name(F.col("subject")).alias("subject_id"), "camera_id", "first_s", "last_s")


LINKED = "post bigint, id bigint, subject_id string, camera_id string, first_s bigint, last_s bigint"


def subject_name(number: Column) -> Column:
    return F.concat(F.lit("S"), F.lpad(number.cast("string"), F.greatest(F.lit(4), F.length(number.cast("string"))), F.lit("0")))


def linked(least=1, most=300, similarity: float = 0.72, ttl=1800, carry: tuple[str, ...] | None = None):
    """The step of a post's fold over its sightings (post, id, camera_id, first_s, last_s, hist). With carry, subjects are numbers, and
    the columns of carry follow."""
    import numpy as np

    def step(held, r):
        if r is None:
            return []
        live = [s for s in held.get("live", []) if r.first_s - s["last"] <= ttl]
        hist = np.asarray(r.hist, float)
        best, score = None, similarity
        for s in live:
            if r.camera_id not in s["cameras"] and least <= r.first_s - s["last"] <= most:
                got = float(np.minimum(s["hist"], hist).sum())
                if got >= score:
                    best, score = s, got
        if best is None:
            held["n"] = held.get("n", 0) + 1
            best = {"id": held["n"] if carry is not None else f"S{held['n']:04d}", "cameras": set(), "hist": hist, "last": r.last_s}
            live.append(best)
        else:
            mixed = 0.7 * best["hist"] + 0.3 * hist
            best["hist"] = mixed / mixed.sum()
        best["cameras"].add(r.camera_id)
        best["last"] = max(best["last"], r.last_s)
        held["live"] = live
        return [(r.post, r.id, best["id"], r.camera_id, r.first_s, r.last_s, *(getattr(r, c) for c in carry or ()))]

    return step


def subject_summary(linked: DataFrame) -> DataFrame:
    """Subjects with their cameras in order of first sight; on several cameras they are inferred."""
    per = linked.groupBy("post", "subject_id", "camera_id").agg(F.min("first_s").alias("f"), F.max("last_s").alias("l"), F.count("*").alias("n"))
    out = per.groupBy("post", "subject_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("f", "camera_id"))), lambda x: x["camera_id"]).alias("cameras"), F.sum("n").alias("sightings"), F.min("f").alias("first_s"), F.max("l").alias("last_s"))
    return out.withColumn("inferred", F.size("cameras") > 1)


def match_roster(faces: DataFrame, roster: DataFrame, threshold: float = 0.45, similarity=None, rows: int = 100_000) -> DataFrame:
    """Faces (face_id, vec) with the person (person_id, position, vec) of the most similar roster vector at or above the
    threshold, the first of equals; person_id is null for others. Similarity is the cosine, or a function of two columns.

    The roster is sent to all tasks in parts of about `rows` vectors, of each of which a face keeps its best. With cosines a part is
    held in blocks about pivots, and a face is compared with the blocks in which the angles to the pivots leave room for a better
    one (`roster.Known`), as products of matrices; vectors of another length than the face's are not compared. Another similarity
    is worked out for each pair.
    """
    parts_n = max(1, -(-roster.count() // rows))
    r = roster.select("person_id", F.col("position").cast("long").alias("position"), F.col("vec").cast("array<double>").alias("vec")).where("vec is not null")
    rank, parts = F.struct(F.col("similarity"), -F.col("position")), []
    kinds = f"face_id {faces.schema['face_id'].dataType.simpleString()}, person_id {roster.schema['person_id'].dataType.simpleString()}"
    for b in range(parts_n):
        part = r if parts_n == 1 else r.where(F.pmod(F.xxhash64("position"), F.lit(parts_n)) == b)
        if similarity is None:
            sent = roster.sparkSession.sparkContext.broadcast(part.orderBy("position").toArrow())
            parts.append(faces.select("face_id", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(_matched(sent), f"{kinds}, similarity double, position bigint"))
        else:
            j = faces.join(F.broadcast(part.withColumnRenamed("vec", "known")), F.lit(True)).withColumn("similarity", similarity(F.col("vec"), F.col("known")))
            parts.append(j.groupBy("face_id").agg(F.max_by(F.struct("person_id", "similarity", "position"), rank).alias("b")).select("face_id", "b.*"))
    best = reduce(DataFrame.unionByName, parts).groupBy("face_id").agg(F.max_by(F.struct("person_id", "similarity"), rank).alias("b"))
    ok = F.col("b.similarity") >= threshold
    return best.select("face_id", F.when(ok, F.col("b.person_id")).alias("person_id"), F.col("b.similarity").alias("similarity"))


def _matched(sent):
    """Faces with the best of a broadcast part of the roster."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        from wardline.operators.roster import Known

        t, known = sent.value, {}
        sizes = np.array([len(v) for v in t.column("vec")], np.int64)
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            known[int(n)] = at, Known.of(np.array(t.column("vec").take(pa.array(at)).to_pylist(), float).reshape(len(at), n))
        for batch in batches:
            vecs = batch.column("vec").to_pylist()
            size, row, score = np.array([-1 if v is None else len(v) for v in vecs]), np.full(len(vecs), -1, np.int64), np.zeros(len(vecs))
            for n, (at, some) in known.items():
                mine = np.flatnonzero(size == n)
                if mine.size:
                    got, score[mine], _ = some.nearest(np.array([vecs[i] for i in mine], float).reshape(len(mine), n))
                    row[mine] = at[got]
            pick = pa.array(np.where(row < 0, 0, row), mask=row < 0)
            person, position = (t.column(c).combine_chunks().take(pick) for c in ("person_id", "position"))
            yield pa.RecordBatch.from_arrays([batch.column("face_id"), person, pa.array(score, mask=row < 0), position], ["face_id", "person_id", "similarity", "position"])

    return work


def settle_identity(matches: DataFrame, key: str, least: int = 2, order: str = "face_id") -> DataFrame:
    """Rows (key, person_id, votes): the person most of a track's recognised faces agree on (the one seen first on a tie), if at
    least `least` do and the best single match is that person's."""
    m = matches.where("person_id is not null")
    votes = m.groupBy(key, "person_id").agg(F.count("*").alias("votes"), F.min(order).alias("first"), F.max(F.struct("similarity", (-F.col(order)).alias("o"))).alias("best"))
    top = votes.groupBy(key).agg(F.max_by(F.struct("person_id", "votes"), F.struct("votes", -F.col("first"))).alias("t"), F.max_by("person_id", "best").alias("best_person"))
    return top.where((F.col("t.votes") >= least) & (F.col("t.person_id") == F.col("best_person"))).select(key, "t.person_id", "t.votes")


def identity_points(person: Column, faces: Column, authorised: int = -45, unrecognised: int = 0) -> Column:
    """Points of an identity: an authorised person's, else those of an unrecognised face if any are set."""
    return F.when(person.isNotNull(), authorised).when(faces > 0, unrecognised).otherwise(0)


def identity_behaviours(identities: DataFrame, authorised: int = -45, unrecognised: int = 0, nth: int = 50) -> DataFrame:
    """Findings for `risk.with_findings` (camera_id, track_id, from_k, nth, name, points, detail) of tracks with faces: identities has
    camera_id, track_id, from_k, person_id (null if none is recognised), label, role, similarity. A person of the roster is
    AUTHORISED PERSON; a face that is not on it is UNRECOGNISED PERSON, if points are set for that."""
    known = F.col("person_id").isNotNull()
    who = F.coalesce("label", F.col("person_id").cast("string"))
    role = F.when(F.coalesce("role", F.lit("")) != "", F.concat(F.lit(", "), "role")).otherwise("")
    detail = F.when(known, F.format_string("recognised as %s%s (%.2f)", who, role, F.col("similarity"))).otherwise("face not on the roster for this post")
    out = identities.where(known | F.lit(unrecognised != 0))
    return out.select(
        "camera_id", "track_id", "from_k", F.lit(nth).alias("nth"), F.when(known, "AUTHORISED PERSON").otherwise("UNRECOGNISED PERSON").alias("name"),
        F.when(known, authorised).otherwise(unrecognised).alias("points"), detail.alias("detail"))


def upsert_roster(roster: DataFrame, new: DataFrame) -> DataFrame:
    """roster without the persons of new, and new; persons without vectors are skipped."""
    new = new.where("vec is not null and size(vec) > 0")
    return roster.join(new.select("person_id").distinct(), "person_id", "left_anti").unionByName(new)


def assign_tracks(detections: DataFrame, key: tuple[str, ...] = ("camera_id",), iou: float = 0.3, max_missed: int = 15, revive: float = 0.55, memory: int = 150) -> DataFrame:
    """detections (key, frame, det_id, confidence, x1, y1, x2, y2, hist) with the track each belongs to: rows (key, frame, det_id,
    track_id).

    In each frame detections take, surest first, the free track they overlap most (at least `iou`; the later of equals); those
    left revive a lost track that looks alike, or start a new one. A track missed in more than max_missed frames is lost, and
    forgotten when `memory` frames have passed since it was last seen. Frames without detections have no rows, but pass all the same.

    A key's frames are cut where so many are empty that no track outlasts them; the pieces are folded in parallel, each in
    order, keeping tracks and one frame, and tracks are counted through afterwards.
    """
    d = boxes(detections, key)
    d = folds.segments(d, list(key), "frame", "frame", max(max_missed, memory) + 1)
    own = (*key, "segment_")
    got = cut(folds.in_order(d, list(own), ["frame", "det_id"], tracked(own, iou, max_missed, revive, memory), tracks_of(d, own)))
    return folds.numbered(got, list(key), "track_id").select(*key, "frame", "det_id", "track_id")


def boxes(detections: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """What the tracker needs of detections; those without a frame belong to no track."""
    return detections.select(*key, F.col("frame").cast("long"), "det_id", "confidence", "x1", "y1", "x2", "y2", "hist").where("frame is not null")


def tracks_of(detections: DataFrame, key: tuple[str, ...]) -> str:
    """The schema of tracked detections."""
    return ", ".join([*[f"{k} {detections.schema[k].dataType.simpleString()}" for k in key], "frame bigint, det_id bigint, track_id bigint"])


def tracked(key: tuple[str, ...] = ("camera_id",), iou: float = 0.3, max_missed: int = 15, revive: float = 0.55, memory: int = 150):
    """The step of a camera's fold over its detections in order of frames. A frame's rows are given back when the next frame begins.
    Held are the live and lost tracks, the lost ones' descriptors as rows of a matrix, and the frame's rows so far."""
    import numpy as np

    def last_best(scores, least):
        """Place of the greatest score, the last of equals, or None below `least`."""
        if not len(scores):
            return None
        best = len(scores) - 1 - int(np.argmax(scores[::-1]))
        return best if scores[best] >= least else None

    def seen(t, box, hist, now):
        t |= {"box": box, "last": now}
        if hist is not None:
            mixed = hist if t["hist"] is None else 0.7 * t["hist"] + 0.3 * hist
            t["hist"] = mixed / np.add.reduce(mixed)

    def overlaps(boxes, at):
        """Of each box with each live track."""
        b = boxes[:, None]
        size = np.minimum(at[:, 2:], b[..., 2:]) - np.maximum(at[:, :2], b[..., :2])
        both = np.where((size > 0).all(axis=2), size[..., 0] * size[..., 1], 0.0)
        areas, own = (at[:, 2] - at[:, 0]) * (at[:, 3] - at[:, 1]), (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
        return np.divide(both, areas + own[:, None] - both, out=np.zeros(both.shape), where=both > 0)

    def passed(held, now):
        """Live and lost tracks at a frame, however many frames after the last one with detections it is."""
        live, lost, looks = held.get("live", []), held.get("lost", []), held.get("looks")
        if now < held.get("look", now):  # nothing can be lost or forgotten before
            return live, lost, looks
        gone = sorted((t for t in live if now - t["last"] > max_missed + 1), key=lambda t: t["last"])  # in the order in which they were lost
        gone = [t for t in gone if t["hist"] is not None]
        still = np.array([now - t["last"] <= memory + 1 for t in (*lost, *gone)], bool)
        if gone or not still.all():
            looks = np.concatenate([*([looks] if lost else []), *([np.array([t["hist"] for t in gone])] if gone else [])])[still]
            lost = [t for t, s in zip((*lost, *gone), still, strict=True) if s]
        live = [t for t in live if now - t["last"] <= max_missed + 1]
        held["look"] = min([now + 2 + min(max_missed, memory), *[t["last"] + max_missed + 2 for t in live], *[t["last"] + memory + 2 for t in lost]])
        return live, lost, looks

    def frame_done(held):
        now = held["rows"][0][1]
        live, lost, looks = passed(held, now)
        rows = sorted(held["rows"], key=lambda r: (r[3] is None, -(r[3] or 0)))
        out, open_, taken, still = [], range(len(rows)), {}, None
        if live:
            shared = overlaps(np.array([r[4:8] for r in rows], float), np.array([t["box"] for t in live], float))
            # of each row the tracks that overlap enough, best first, the later of equals; most have a few at most
            near, open_ = [[] for _ in rows], []
            for i, j in np.argwhere(shared >= iou).tolist():
                near[i].append((shared[i, j], j))
            for i, r in enumerate(rows):
                best = max((x for x in near[i] if x[1] not in taken), default=None)
                if best is None:
                    open_.append(i)
                    continue
                t = live[best[1]]
                taken[best[1]] = True
                seen(t, r[4:8], None if r[8] is None else np.asarray(r[8], float), now)
                out.append((r, t["id"]))
        for i in open_:
            r = rows[i]
            hist, best = None if r[8] is None else np.asarray(r[8], float), None
            if hist is not None and lost:
                still = np.ones(len(lost), bool) if still is None else still
                best = last_best(np.where(still, np.add.reduce(np.minimum(looks, hist), axis=1), -1.0), revive)
            if best is None:
                held["n"] = held.get("n", 0) + 1
                t = {"id": held["n"], "hist": None}
            else:
                still[best], t = False, lost[best]
            seen(t, r[4:8], hist, now)
            live.append(t)
            out.append((r, t["id"]))
        if still is not None and not still.all():
            lost, looks = [t for t, s in zip(lost, still, strict=True) if s], looks[still]
        held |= {"live": live, "lost": lost, "looks": looks, "rows": []}
        return [(*r[0], r[1], r[2], t) for r, t in out]

    def step(held, r):
        rows = held.setdefault("rows", [])
        out = frame_done(held) if rows and (r is None or r.frame != rows[0][1]) else []
        if r is not None:
            held["rows"].append((tuple(getattr(r, k) for k in key), r.frame, r.det_id, r.confidence, r.x1, r.y1, r.x2, r.y2, r.hist))
        return out

    return step


def newest_first(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
