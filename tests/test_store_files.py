"""The store's files, and sinks that get an epoch twice."""

import re

import pytest
from oracle import same
from pyspark.sql import functions as F

from wardline.operators import store
from wardline.plans import readside
from wardline.sources import sinks

ROW = "event_id long, event_date date, seq int, camera_id string, plate string, at_s long"


def events(spark, ids, seq=1, plate="P"):
    d = spark.createDataFrame([(i, seq, f"C{i % 3}", f"{plate}{i}", 86_400 * (i % 4)) for i in ids], "event_id long, seq int, camera_id string, plate string, at_s long")
    return d.withColumn("event_date", F.to_date(F.timestamp_seconds("at_s"))).select(*[c.split()[0] for c in ROW.split(", ")])


def test_equal_versions(spark):
    old, new = events(spark, range(50)), events(spark, range(0, 50, 2), plate="N")
    for seq in (0, 1, 2):
        again = new.withColumn("seq", F.lit(seq))
        got = {r.event_id: r.plate[0] for r in store.upsert(old, again).collect()}
        assert got == {i: "N" if i % 2 == 0 else "P" for i in range(50)}
        kept = {r.event_id: r.plate[0] for r in store.upsert(old, again, replace=False).collect()}
        assert kept == {i: "N" if i % 2 == 0 and seq >= 1 else "P" for i in range(50)}
    twice = new.unionByName(new.withColumn("plate", F.lit("Z"))).unionByName(new.withColumn("seq", F.lit(0)))
    one = sorted(map(tuple, store.upsert(old, twice).collect()))
    assert len(one) == 50 and one == sorted(map(tuple, store.upsert(old, twice.repartition(7)).collect()))


def test_first_write_has_one_row_a_key(spark, tmp_path):
    path = str(tmp_path / "s")
    sinks.store(events(spark, [1, 2]).unionByName(events(spark, [1], seq=2, plate="N")), path)
    assert {(r.event_id, r.plate) for r in spark.read.parquet(path).collect()} == {(1, "N1"), (2, "P2")}


def test_broken_write_is_picked_up(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    sinks.store(events(spark, range(20)), path)
    real = sinks.recover
    calls = []

    def breaks(*a):
        calls.append(a)
        if len(calls) == 2:
            raise OSError("lost")
        real(*a)

    monkeypatch.setattr(sinks, "recover", breaks)
    with pytest.raises(OSError):
        sinks.store(events(spark, [4, 8], seq=2, plate="N"), path)
    monkeypatch.undo()
    events(spark, [1]).write.parquet(f"{path}-new-half")
    (tmp_path / "s-new-half" / "_SUCCESS").unlink()
    assert len(list(tmp_path.iterdir())) == 3
    sinks.store(events(spark, [3], seq=3, plate="M"), path)
    got = {r.event_id: r.plate[0] for r in spark.read.parquet(path).collect()}
    assert got == {i: "N" if i in (4, 8) else "M" if i == 3 else "P" for i in range(20)}
    assert [p.name for p in tmp_path.iterdir()] == ["s"]


def test_searches_read_few_files(spark, tmp_path):
    """Days are pruned by `since`, predicates reach the scan, and files are clustered by camera with Bloom filters."""
    path = str(tmp_path / "s")
    sinks.store(events(spark, range(400)), path)
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    got = store.search(spark.read.parquet(path), camera="C1", plate="P5", since=86_400)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[isnotnull\(event_date#\d+\), \(event_date#\d+ >= ", plan)
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(camera_id,C1\)[^\]]*EqualTo\(plate,P5\)", plan)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert not [r for r in got.collect() if r.event_date.isoformat() < "1970-01-02"]
    assert [r.event_id for r in store.search(spark.read.parquet(path), plate="P5", since=86_400).collect()] == [5]
    import pyarrow.parquet as pq

    seen = {}
    for f in (tmp_path / "s").rglob("*.parquet"):
        cams = pq.read_table(f, columns=["camera_id"]).column("camera_id").to_pylist()
        assert cams == sorted(cams)
        seen[f.parent.name, f.name] = f.stat().st_size
    assert {d for d, _ in seen} == {f"event_date=1970-01-0{k}" for k in range(1, 5)}
    sinks.store(events(spark, range(400)), str(tmp_path / "bare"), bloom=())
    bare = sum(f.stat().st_size for f in (tmp_path / "bare").rglob("*.parquet"))
    assert sum(seen.values()) > 1.2 * bare  # the filters are in the files


def test_repeated_epoch_counts_once(spark, tmp_path):
    """A batch whose sinks fail in turn comes again, and each row is written once."""
    path, seen = str(tmp_path / "j"), []
    state = {"fail": True}

    def broken(b, e):
        if state["fail"]:
            raise RuntimeError("down")
        seen.append(("broken", e, b.count()))

    rows = events(spark, range(30)).withColumn("at", F.timestamp_seconds("at_s"))
    write = sinks.fan_out(lambda b, e: sinks.epoch_json(b, e, path, "at"), broken, lambda b, e: seen.append(("last", e, b.count())), manifest=str(tmp_path / "m"))
    with pytest.raises(RuntimeError):
        write(rows, 0)
    state["fail"] = False
    write(rows, 0)
    write(rows, 0)
    write(rows.limit(5), 1)
    assert sorted(seen) == [("broken", 0, 30), ("broken", 1, 5), ("last", 0, 30), ("last", 1, 5)]
    got = sinks.committed(spark, path, "event_id long, epoch int, day string")
    assert got.count() == 35 and got.where("epoch = 0").select("event_id").distinct().count() == 30
    sinks.epoch_json(rows, 0, path, "at")  # broke off before it was recorded, and comes again
    (tmp_path / "j" / "epoch=1" / "_SUCCESS").unlink()
    assert sinks.committed(spark, path, "event_id long, epoch int").count() == 30


def test_oracle(spark):
    same(spark, "/root/testdata/sf0.001", readside.QUERIES["store_upsert_any_version"], readside.ORACLE["store_upsert_any_version"])
