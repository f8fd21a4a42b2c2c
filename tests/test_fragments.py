"""Plate candidates of text fragments against the rule written out."""

import random

from wardline.operators import plates


def by_rule(items):
    items = sorted(items, key=lambda b: ((b[3] + b[4]) / 2, b[5]))
    rows = []
    for b in items:
        mid, height = (b[3] + b[4]) / 2, max(1.0, b[4] - b[3])
        home = next((r for r in rows if abs((r[0][3] + r[0][4]) / 2 - mid) <= 0.6 * height), None)
        rows.append([b]) if home is None else home.append(b)
    rows = [sorted(r, key=lambda b: (b[5], (b[3] + b[4]) / 2)) for r in rows]
    groups = [[b] for r in rows for b in r] + [r for r in rows if len(r) > 1] + [a + b for a, b in zip(rows, rows[1:])]
    out = [("".join(b[1] for b in g), min(b[2] for b in g)) for g in groups]
    out = [c for c in out if 4 <= len(c[0]) <= 13 and any(x.isdigit() for x in c[0]) and any(x.isalpha() for x in c[0])]
    return sorted(out, key=lambda c: (not 8 <= len(c[0]) <= 11, -c[1], c[0]))


def test_fragments(spark):
    draw, rows = random.Random(4), []
    for image in range(150):
        for k in range(draw.randint(1, 7)):
            top = draw.choice([0.0, 5.0, 12.0, 30.0, 33.0]) + draw.random()
            rows.append((image, draw.choice(["DL", "03", "AB1234", "MH12", "9", "TAXI", "KA05MN77"]), round(draw.random(), 3), top, top + draw.choice([0.5, 10.0, 20.0]), draw.random() * 100))
    want = {i: by_rule([r for r in rows if r[0] == i]) for i in range(150)}
    df = spark.createDataFrame(rows, "image int, text string, confidence double, top double, bottom double, left double")
    got = plates.fragments(df)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
    have = {i: [] for i in range(150)}
    for r in sorted(got.collect(), key=lambda r: (r.image, r.nth)):
        have[r.image].append((r.text, r.confidence))
    assert have == want
