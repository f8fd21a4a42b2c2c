"""Fires after a cooldown against a walk over the rows."""

import random

import pytest

from wardline.operators import folds


def walk(rows, wait, ranked):
    out, last = [], {}
    for k, t, e, r in sorted(rows, key=lambda x: (str(x[0]), x[1], x[2])):
        if k not in last or t - last[k][0] >= wait or ranked and r > last[k][1]:
            last[k] = t, r
            out.append((k, t, e))
    return sorted(out, key=repr)


@pytest.mark.parametrize("ranked", [True, False])
@pytest.mark.parametrize("split", [True, False])
def test_against_a_walk(spark, ranked, split):
    draw, rows = random.Random(ranked + 2 * split), []
    for k in ("a", "b", None, "hot"):
        t = 0
        for i in range(3000 if k == "hot" else 120):
            t += draw.choice([0, 1, 1, 2, 9, 10, 11, 40]) if k != "hot" else draw.choice([0, 1, 2, 3])
            rows.append((k, t, i, draw.randint(0, 3)))
    df = spark.createDataFrame(rows, "k string, t long, event_id long, rank int").repartition(5)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)  # a key's rows reach over many batches
        got = folds.cooldown(df, ["k"], "t", ["rank"], 10, "rank" if ranked else None, split=split)
        assert got.columns == ["k", "t", "event_id", "rank"]
        assert sorted(((r.k, r.t, r.event_id) for r in got.collect()), key=repr) == walk(rows, 10, ranked)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert folds.cooldown(df.limit(0), ["k"], "t", ["rank"], 10, split=split).count() == 0


def test_one_key_of_many_rows(spark):
    """A key's whole history is never one value."""
    df = spark.range(2_000_000).selectExpr("'P' as k", "id * 3 as t", "id as event_id")
    assert folds.cooldown(df, ["k"], "t", [], 10, split=True).count() == 500_000
