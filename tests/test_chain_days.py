"""A log in two levels, tampered with in every way."""

import pytest
from pyspark.sql import functions as F

from wardline.operators import integrity

ROW = "camera_id string, day long, n long, event string, ts string, payload string"


def log(spark, days=range(4), cameras="AB", each=5):
    return spark.createDataFrame([(c, d, 100 * d + i, f"{c}{d}-{i}", None if i == 3 else str(i), f"p{i}") for c in cameras for d in days for i in range(each)], ROW)


@pytest.fixture(scope="module")
def made(spark):
    linked, heads = integrity.append_days(log(spark), ["camera_id"], "day", "n")
    return linked.cache(), heads.cache()


def breaks(linked, heads):
    return sorted((tuple(r) for r in integrity.verify_days(linked, heads, ["camera_id"], "day").collect()), key=repr)


def test_untouched(made):
    linked, heads = made
    assert breaks(linked, heads) == [] and heads.count() == 8 and linked.count() == 40
    one = linked.where("camera_id = 'A' and day = 2").orderBy("seq").collect()
    assert one[0].prev_hash == integrity.GENESIS and all(b.prev_hash == a.hash for a, b in zip(one, one[1:]))


def test_tampering(made):
    linked, heads = made
    at = (F.col("camera_id") == "A") & (F.col("day") == 1)
    mine = lambda i: at & (F.col("event") == f"A1-{i}")
    change = lambda df, where, c, v: df.withColumn(c, F.when(where, v).otherwise(F.col(c)))
    end = ("A", 1, None, "day does not end as its head says")
    gone = ("A", 1, "A1-3", "previous changed or removed")
    assert breaks(change(linked, mine(2), "payload", F.lit("x")), heads) == [("A", 1, "A1-2", "contents changed")]
    assert breaks(linked.where(~mine(2)), heads) == [gone, end]
    assert breaks(linked.where(~mine(4)), heads) == [end]  # the end of a day, which its own links do not show
    assert breaks(linked.where(~at), heads) == [("A", 1, None, "day removed")]
    assert breaks(linked, heads.where(~at)) == sorted([("A", 1, None, "day without a head"), ("A", 2, None, "head: previous changed or removed")], key=repr)
    assert breaks(change(linked, mine(1), "hash", F.lit(None)), heads)[0][3] in ("unchained", "previous changed or removed")
    forged = integrity.append(log(linked.sparkSession, [1], "A").withColumn("payload", F.lit("forged")), ["camera_id", "day"], "n").select(linked.columns)
    assert breaks(linked.where(~at).unionByName(forged), heads) == [end]  # a day written anew from its beginning
    swapped = change(change(linked, mine(1), "seq", F.lit(3)), mine(2), "seq", F.lit(2))
    assert any(b[3] == "previous changed or removed" for b in breaks(swapped, heads))


def test_later_days_go_on(spark, made):
    linked, heads = made
    rows, more = integrity.append_days(log(spark, [4, 5], "ABC"), ["camera_id"], "day", "n", heads)
    assert breaks(linked.unionByName(rows), more) == [] and more.count() == 8 + 6
    whole = integrity.append_days(log(spark, range(6)), ["camera_id"], "day", "n")[1]
    assert sorted(map(tuple, more.where("camera_id <> 'C'").select("camera_id", "day", "hash", "seq").collect())) == sorted(map(tuple, whole.select("camera_id", "day", "hash", "seq").collect()))
    with pytest.raises(ValueError):
        integrity.append_days(log(spark, [2]), ["camera_id"], "day", "n", heads)


def test_proof(made):
    linked, heads = made
    newest = heads.where("camera_id = 'B' and day = 3").first().hash
    steps = integrity.proof(linked, heads, {"camera_id": "B"}, "day", 1, "B1-2")
    assert [len(x) for x in steps] == [3, 3] and integrity.proven(steps, "B1-2", newest)
    assert not integrity.proven(steps, "B1-1", newest) and not integrity.proven(steps, "B1-2", heads.where("camera_id = 'A' and day = 3").first().hash)
    row = steps[0][0]
    assert not integrity.proven([[(row[0], row[1], "other", *row[3:]), *steps[0][1:]], steps[1]], "B1-2", newest)
