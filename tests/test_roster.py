"""The nearest known vector against every pair."""

import numpy as np
import pytest

from wardline.functions import vectors as V
from wardline.operators import crosscam
from wardline.operators.roster import Known


def every_pair(faces, known):
    a, b = (x / np.where(n == 0, 1, n) for x, n in ((x, np.linalg.norm(x, axis=1, keepdims=True)) for x in (faces, known)))
    s = a @ b.T
    top = s.max(axis=1)
    return (s >= top[:, None] - 1e-12).argmax(axis=1), top


@pytest.mark.parametrize("kind", ["people", "spread", "few"])
def test_nearest(kind):
    draw = np.random.default_rng(3)
    people = draw.normal(size=(300, 48))
    known = people.repeat(10, axis=0) + 0.25 * draw.normal(size=(3000, 48)) if kind == "people" else draw.normal(size=(3000 if kind == "spread" else 5, 48))
    known[2] = known[1]  # the first of equals
    faces = np.concatenate([known[:200] + 0.1 * draw.normal(size=(min(200, len(known)), 48)), draw.normal(size=(50, 48)), known[2:3] * 3, np.zeros((1, 48))])
    row, score, compared = Known.of(known, each=16).nearest(faces)
    want, top = every_pair(faces, known)
    assert np.allclose(score, top, atol=1e-12) and (row == want).all()
    if kind == "people":
        assert compared < 0.7 * len(faces) * len(known)  # 0.43 here; and of faces of the roster's people a twentieth
        assert Known.of(known, each=16).nearest(faces[:200])[2] < 0.2 * 200 * len(known)


def test_vectors_without_a_direction():
    known = np.array([[0.0, 0.0], [-1.0, 0.0], [0.0, -1.0]])
    row, score, _ = Known.of(known).nearest(np.array([[1.0, 1.0], [-1.0, 0.1], [0.0, 0.0]]))
    assert row.tolist() == [0, 1, 0] and score[0] == 0 and score[2] == 0
    row, score, n = Known.of(np.zeros((2, 3))).nearest(np.ones((2, 3)))
    assert row.tolist() == [0, 0] and n == 0


def test_same_as_the_join(spark):
    draw = np.random.default_rng(5)
    roster = [(int(k // 3), k, draw.normal(size=8).tolist()) for k in range(60)] + [(90, 60, [1.0, 0.0]), (91, 61, [0.0] * 8)]
    faces = [(i, (np.array(roster[i % 60][2]) + 0.3 * draw.normal(size=8)).tolist()) for i in range(100)] + [(200, roster[7][2]), (201, None), (202, [2.0, 0.1]), (203, [0.0] * 8)]
    r = spark.createDataFrame(roster, "person_id long, position int, vec array<double>")
    f = spark.createDataFrame(faces, "face_id long, vec array<double>")
    got = {x.face_id: (x.person_id, x.similarity and round(x.similarity, 9)) for x in crosscam.match_roster(f, r).collect()}
    same = f.where("size(vec) = 8")
    want = {x.face_id: (x.person_id, round(x.similarity, 9)) for x in crosscam.match_roster(same, r.where("size(vec) = 8"), similarity=V.cosine).collect()}
    assert {i: v for i, v in got.items() if i in want} == want and len(got) == 104
    assert got[201] == (None, None) and got[202][0] == 90 and got[203] == (None, 0.0)
    blocks = {x.face_id: (x.person_id, x.similarity and round(x.similarity, 9)) for x in crosscam.match_roster(f, r, rows=7).collect()}
    assert blocks == got
