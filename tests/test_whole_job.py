"""Results that a partial job would miss, against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

from wardline.functions import plates as P
from wardline.operators import crosscam, integrity, links, site
from wardline.plans import catalog
from wardline.plans.fixtures import view

SF = "/root/testdata/sf0.001"


def normalise(raw):
    """A valid plate number that the read is close to, or None."""
    digit, letter = str.maketrans(*P.TO_DIGIT), str.maketrans(*P.TO_LETTER)
    text = re.sub("[^A-Z0-9]", "", (raw or "").upper())
    if not 8 <= len(text) <= 11:
        return None

    def close(c):
        return sum(a != b for a, b in zip(text, c)) <= 3 if len(c) == len(text) else abs(len(text) - len(c)) <= 1

    tried = [text]
    if len(text) >= 9:
        d, s = "", ""
        for ch in text[2:-4]:
            if not s and len(d) < 2 and ch.translate(digit).isdigit():
                d += ch.translate(digit)
            else:
                s += ch.translate(letter)
        if d:
            tried.append(text[:2].translate(letter) + d + s + text[-4:].translate(digit))
        if text[2:4].translate(letter) == "BH":
            tried.append(text[:2].translate(digit) + "BH" + text[4:8].translate(digit) + text[8:].translate(letter))
    for c in tried:
        m = re.match(P.STANDARD, c)
        if (m and m[1] in P.STATES or re.match(P.BHARAT, c)) and close(c):
            return c
        if m:
            near = {m[1][:i] + to + m[1][i + 1 :] for i in (0, 1) for to in P.LOOKALIKE.get(m[1][i], "") if to.isalpha()} & set(P.STATES)
            fixed = m[1] if m[1] in P.STATES else near.pop() if len(near) == 1 else None
            if fixed and close(fixed + c[2:]):
                return fixed + c[2:]
    return None


def voted(texts):
    """Agreed text, or None, and reads of its length; texts in order."""
    n = Counter(map(len, texts))
    length = max(n, key=lambda x: (n[x], -[len(t) for t in texts].index(x)))
    tops = [Counter(c).most_common(2) for c in zip(*[t for t in texts if len(t) == length])]
    clear = n[length] >= 2 and all(len(t) == 1 or t[0][1] > t[1][1] for t in tops)
    return "".join(t[0][0] for t in tops) if clear else None, n[length]


def test_repaired_plates(spark):
    """Queries over repaired plates, against the rules in Python."""
    run = lambda name: catalog.QUERIES[name](spark, SF).collect()
    ocr = view(spark, SF, "fx_ocr").collect()
    got = [(r, normalise(r.raw)) for r in sorted(ocr, key=lambda r: r.k)]
    good = [(r, p) for r, p in got if p and r.sharpness >= 45 and r.ocr_conf_pct >= 12]
    assert any(p != re.sub("[^A-Z0-9]", "", r.raw.upper()) for r, p in good)
    tracks = defaultdict(list)
    for r, p in good:
        tracks[r.camera_id, r.track_id].append((r, p))

    votes = {k: voted([p for _, p in v]) for k, v in tracks.items()}
    assert {(r.camera_id, r.track_id): (r.consensus, r.reads) for r in run("plate_consensus")} == votes
    # a track has a consensus of 40 reads or its three most frequent plates
    unsure = {(*k, p, n) for k, v in tracks.items() if votes[k][0] is None or votes[k][1] < 40 for p, n in sorted(Counter(p for _, p in v).items(), key=lambda x: (-x[1], x[0]))[:3]}
    assert {(r.camera_id, r.track_id, r.plate, r.n) for r in run("plate_unconfirmed")} == unsure

    registry = {r.plate: r for r in view(spark, SF, "fx_registry").collect()}
    first = {k: (v[0][1], v[0][1] in registry, getattr(registry.get(v[0][1]), "status", "") == "STOLEN") for k, v in tracks.items()}
    checked = run("registry_check")
    assert {(r.camera_id, r.track_id): (r.plate, r.known, r.flagged) for r in checked} == first
    raw = {(r.camera_id, r.track_id): r.known for r in run("registry_check_as_read")}
    assert sum(r.known for r in checked if r.plate in registry) > sum(raw.values())

    fleet = {p: (n, max(r.ocr_conf_pct / 100 for r, q in good if q == p)) for p, n in Counter(p for _, p in good).items()}
    assert {r.plate: (r.reads, r.confidence) for r in run("fleet_plates")} == fleet

    passes = defaultdict(list)
    seen, nth = {}, Counter()
    for r, p in got:
        k = (r.camera_id, r.track_id)
        nth[k] += k not in seen or r.stream_ms - seen[k] > 2000
        seen[k] = r.stream_ms
        passes[(*k, nth[k])].append((r, p if r.sharpness >= 45 and r.ocr_conf_pct >= 12 else None))
    best = {k: max(((r.ocr_conf_pct, r.k, p) for r, p in v if p), default=(0, 0, None))[2] for k, v in passes.items()}
    assert {(r.camera_id, r.track_id, r.pass_no): r.plate for r in run("vehicle_passes")} == best

    kept = defaultdict(list)
    for k, v in tracks.items():
        for r, p in v:
            s = kept[k]
            if r.veh_w >= 180 and (not s or len(s) < 12 and r.k - s[-1][0].k >= 10 and (max(Counter(q for _, q in s).values()) < 3 or r.veh_area >= 1.15 * max(x.veh_area for x, _ in s))):
                s.append((r, p))
    assert {r.event_id for r in run("read_sampling")} == {r.event_id for s in kept.values() for r, _ in s}

    last, out = {}, set()
    ends = sorted((v[-1][0].stream_ms, v[0][0].stream_ms, k, best[k] or f"{k[0]}#{k[1]}") for k, v in passes.items())
    for end, _, k, key in ends:
        if key not in last or end - last[key] >= 10_000:
            last[key] = end
            out.add((key, k[0], k[1], end))
    assert {(r.pass_key, r.camera_id, r.track_id, r.last_ms) for r in run("pass_suppression")} == out


def test_nearest_of_many(spark):
    """Above the switch by size the neighbours are those of comparing all with all: dense, sparse, polar, across the date line."""
    rng = np.random.default_rng(5)
    near = [(28.6 + a, 77.2 + b) for a, b in rng.normal(0, 0.01, (60, 2))]
    far = list(zip(rng.uniform(-89.9, 89.9, 60), rng.uniform(-180, 180, 60), strict=True))
    rest = [(80.0, 10 + i * 0.2) for i in range(6)] + [(80.5, 10.0), (0.0, 179.999), (0.0, -179.999), (0.01, 179.9), (89.99, 0.0), (89.99, 180.0)]
    places = [(f"C{i:03d}", float(a), float(b)) for i, (a, b) in enumerate(near + far + rest)] + [("N", None, 1.0)]
    df = spark.createDataFrame(places, "camera_id string, lat double, lon double")
    want, got = ([tuple(r) for r in site.nearest(df, **x).orderBy("camera_id", "nth").collect()] for x in ({}, {"few": 10, "cell": 0.5}))
    assert len(want) == 3 * (len(places) - 1) and got == want


def test_folds_keep_no_history(spark, monkeypatch):
    """Chains, link findings, subjects and tracks come in small batches with keys spread over them, and nothing gathers a key's rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    folded = []
    try:
        rows = [(None if i % 4 == 3 else f"C{i % 4}", i, None if i % 5 == 0 else str(i), str(i), f"p{i}") for i in range(120)]
        c = integrity.append(spark.createDataFrame(rows, "camera_id string, n long, event string, ts string, payload string"), ["camera_id"], "n")
        want, heads = set(), {}
        for k, n, *texts in rows:
            prev, seq = heads.get(k, (integrity.GENESIS, 0))
            h = hashlib.sha256("\x1f".join(x for x in (prev, *texts) if x is not None).encode()).hexdigest()
            heads[k] = (h, seq + 1)
            want.add((k, n, prev, h, seq + 1))
        assert {(r.camera_id, r.n, r.prev_hash, r.hash, r.seq) for r in c.collect()} == want

        monkeypatch.setattr(crosscam, "cut", lambda df, real=crosscam.cut: (folded.append(df), real(df))[1])
        dets = [("C", f, f * 2 + j, 0.9 - j / 10, 100 * j + f, 0, 100 * j + f + 30, 40, [0.9, 0.1] if j else [0.1, 0.9]) for f in range(40) for j in (0, 1) if not (j and 10 <= f < 30)]
        t = crosscam.assign_tracks(spark.createDataFrame(dets, "camera_id string, frame int, det_id long, confidence double, x1 int, y1 int, x2 int, y2 int, hist array<double>"))
        # the second is lost for 20 frames and revived by its looks
        assert {(r.det_id, r.track_id) for r in t.collect()} == {(d[2], d[2] % 2 + 1) for d in dets}

        sights = [(p, 10 * i + p, "AB"[i % 2], 100 * i, 100 * i + 5, [1.0, 0.0]) for p in range(3) for i in range(30)]
        s = crosscam.link_subjects(spark.createDataFrame(sights, "post long, id long, camera_id string, first_s long, last_s long, hist array<double>"))
        assert {(r.post, r.id, r.subject_id) for r in s.collect()} == {(p, i, f"S{i // 20 + 1:04d}") for p, i, *_ in sights}

        states = [("C", i, 100 * i, ("RECONNECTING", "ONLINE")[i % 2]) for i in range(40)]
        f = links.findings(spark.createDataFrame(states, "camera_id string, event_id long, at_s long, state string"))
        assert sum(r.finding == "CAMERA LINK LOST" for r in f.collect()) == 20
        assert len(folded) == 2  # of tracks and of subjects, which are read twice and so cut
        for df in (c, *folded, f):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "MapInArrow" in plan and "FlatMapGroups" not in plan and "collect_list" not in plan
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
