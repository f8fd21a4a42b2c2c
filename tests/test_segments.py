"""Tracks and subjects, folded in pieces, against plain folds over every frame and sighting."""

import random

import pytest

from wardline.operators import crosscam, folds

BOX = "camera_id string, frame int, det_id long, confidence double, x1 int, y1 int, x2 int, y2 int, hist array<double>"
SEEN = "post long, id long, camera_id string, first_s long, last_s long, hist array<double>"


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = w * h if w > 0 and h > 0 else 0
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return both / (area(a) + area(b) - both) if both else 0.0


def blend(old, new):
    mixed = [0.7 * x + 0.3 * y for x, y in zip(old, new)]
    return [x / sum(mixed) for x in mixed]


def every_frame(rows, max_missed=15, memory=150):
    """Track of each detection, by a walk over all frames of a camera, empty ones too."""
    out = {}
    for camera in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == camera]
        live, lost, n = [], [], 0
        for f in range(min(r[1] for r in mine), max(r[1] for r in mine) + 1):
            free, waiting = list(live), []
            for r in sorted(sorted((r for r in mine if r[1] == f), key=lambda r: r[2]), key=lambda r: -r[3]):
                best, score = None, 0.3
                for t in free:
                    if iou(r[4:8], t["box"]) >= score:
                        best, score = t, iou(r[4:8], t["box"])
                if best is None:
                    waiting.append(r)
                    continue
                free.remove(best)
                best |= {"box": r[4:8], "missed": 0, "last": f, "hist": blend(best["hist"], r[8])}
                out[r[2]] = best["id"]
            for r in waiting:
                best, score = None, 0.55
                for t in lost:
                    like = sum(map(min, t["hist"], r[8]))
                    if like >= score:
                        best, score = t, like
                if best is None:
                    n += 1
                    best = {"id": n, "hist": r[8]}
                else:
                    lost.remove(best)
                    best["hist"] = blend(best["hist"], r[8])
                best |= {"box": r[4:8], "missed": 0, "last": f}
                live.append(best)
                out[r[2]] = best["id"]
            for t in free:
                t["missed"] += 1
            lost = [t for t in lost + [t for t in live if t["missed"] > max_missed] if f - t["last"] <= memory]
            live = [t for t in live if t["missed"] <= max_missed]
    return out


def footage(draw, cameras=3, n=160):
    rows, k = [], 0
    for c in range(cameras):
        f = draw.randint(0, 400)
        for _ in range(n):
            f += draw.choice([0, 1, 1, 1, 2, 5, 14, 15, 16, 17, 18, 60, 149, 150, 151, 152, 153, 400])
            x, look = draw.choice([0, 3, 40, 44, 90]), draw.choice([0.05, 0.1, 0.5, 0.9])
            rows.append((f"C{c}", f, k, draw.choice([0.5, 0.7, 0.9]), x, 0, x + 10, 20, [look, 1 - look]))
            k += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_tracks(spark, seed):
    rows = footage(random.Random(seed))
    got = crosscam.assign_tracks(spark.createDataFrame(rows, BOX).repartition(5))
    assert got.columns == ["camera_id", "frame", "det_id", "track_id"]
    assert {r.det_id: r.track_id for r in got.collect()} == every_frame(rows)


def test_empty_frames_count(spark):
    """A track is lost after 15 empty frames; what looks like it 150 frames on revives it, later it is a new one."""
    one = lambda f, k, look: ("C", f, k, 0.9, 0, 0, 10, 20, [look, 1 - look])
    for gap, look, same in ((16, 0.0, True), (17, 0.0, False), (17, 1.0, True), (151, 1.0, True), (152, 1.0, False), (499, 1.0, False)):
        got = {r.det_id: r.track_id for r in crosscam.assign_tracks(spark.createDataFrame([one(1, 1, 1.0), one(1 + gap, 2, look)], BOX)).collect()}
        assert got == {1: 1, 2: 1 if same else 2}, gap


def test_pieces(spark):
    """Pieces are cut where everything before is out of reach, and only there."""
    rows = [("a", 0, 5), ("a", 15, 15), ("a", 26, 26), ("a", 37, 90), ("a", 95, 95), ("a", 100, 100), ("a", 111, 111), (None, 3, 3), (None, 14, 14), (None, 24, 24)]
    got = folds.segments(spark.createDataFrame(rows, "k string, at long, until long"), ["k"], "at", "until", 10).collect()
    assert {(r.k, r.at): r.segment_ for r in got} == {("a", 0): 0, ("a", 15): 0, ("a", 26): 1, ("a", 37): 2, ("a", 95): 2, ("a", 100): 2, ("a", 111): 3, (None, 3): 0, (None, 14): 1, (None, 24): 1}


def every_sighting(rows):
    out = {}
    for post in {r[0] for r in rows}:
        subjects = []
        for _, i, camera, first, last, hist in sorted((r for r in rows if r[0] == post), key=lambda r: (r[3], r[1])):
            best, score = None, 0.72
            for s in subjects:
                if camera not in s["cameras"] and 1 <= first - s["last"] <= 300:
                    like = sum(map(min, s["hist"], hist))
                    if like >= score:
                        best, score = s, like
            if best is None:
                best = {"id": f"S{len(subjects) + 1:04d}", "cameras": {camera}, "hist": hist, "last": last}
                subjects.append(best)
            else:
                best["hist"], best["last"] = blend(best["hist"], hist), max(best["last"], last)
                best["cameras"].add(camera)
            out[i] = best["id"]
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_subjects(spark, seed):
    draw, rows, k = random.Random(seed), [], 0
    for post in range(3):
        t = draw.randint(0, 500)
        for _ in range(150):
            t += draw.choice([0, 1, 2, 10, 40, 120, 299, 300, 301, 302, 700])
            look = draw.choice([0.1, 0.2, 0.5, 0.8])
            rows.append((post, k, f"C{draw.randint(0, 4)}", t, t + draw.choice([0, 1, 30, 250]), [look, 1 - look]))
            k += 1
    got = crosscam.link_subjects(spark.createDataFrame(rows, SEEN).repartition(4))
    assert {r.id: r.subject_id for r in got.collect()} == every_sighting(rows)


def test_more_tasks_than_cameras(spark):
    """One camera's footage of many pieces is dealt to all tasks."""
    rows = [("C", 1000 * k, k, 0.9, 0, 0, 10, 20, None) for k in range(200)]
    d = folds.segments(crosscam.boxes(spark.createDataFrame(rows, BOX), ("camera_id",)), ["camera_id"], "frame", "frame", 151)
    n = [r["count"] for r in d.groupBy("segment_").count().collect()]
    assert len(n) == 200
    got = {r.det_id: r.track_id for r in crosscam.assign_tracks(spark.createDataFrame(rows, BOX)).collect()}
    assert got == {k: k + 1 for k in range(200)}


def test_columns_as_values():
    """A batch's columns become plain values; lists of doubles stay arrays, and nulls nulls."""
    import pyarrow as pa

    assert folds.values(pa.array([1, 2])) == [1, 2] and type(folds.values(pa.array([1, 2]))[0]) is int
    assert folds.values(pa.array([1, None])) == [1, None] and folds.values(pa.array(["a", None])) == ["a", None]
    got = folds.values(pa.array([[0.5, 1.5], None, [], [2.5, None]]).slice(0, 4))
    assert got[0].tolist() == [0.5, 1.5] and got[1] is None and len(got[2]) == 0 and got[3][0] == 2.5 and got[3][1] != got[3][1]
    assert folds.values(pa.array([[9.0], [0.5, 1.5]]).slice(1))[0].tolist() == [0.5, 1.5]
