"""Streaming forms of the stateful operators. Over ordered input they give what the batch forms give."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import vectors as V
from wardline.operators import crosscam, integrity, links

RANKS = {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}
DAY_S = 86_400


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@dataclass(frozen=True)
class Kept:
    """The parts of a key's state. values: columns of one value each; maps: name -> (key column, columns of an entry). A part is read when
    the key has rows, and only the values and entries that have changed are written. unpack turns {column: value, map: {key: entry}}
    into what a step holds, and pack turns that back; without them a step holds just that. The key itself is there as key_."""

    values: tuple[str, ...] = ()
    maps: dict[str, tuple[str, str]] = field(default_factory=dict)
    unpack: Callable[[dict], dict] = dict
    pack: Callable[[dict], dict] = dict


def fold(stream: DataFrame, key: list[str], step: Callable[[dict, object], list[tuple]], out: str, order: list[str], at: str, kept: Kept, late: str = "10 seconds", ttl_s: int = 60) -> DataFrame:
    """Rows that step(held, row) returns, called for each key's rows of a batch in order, nulls first. The steps are those of
    `folds.in_order`: held is the key's state, and step(held, None) gives what is left when the watermark of `at` (a timestamp)
    has passed the key's last row by ttl_s and the state goes, which a timer sees to. Late rows are dropped.

    The state lies in RocksDB, which the session is set to where it has Spark's default."""
    spark, names = stream.sparkSession, [p.strip().split()[0].strip("`") for p in out.split(",")]
    if "HDFSBacked" in spark.conf.get(PROVIDER, "HDFSBacked"):
        spark.conf.set(PROVIDER, ROCKSDB)
    columns = [p.split()[0] for p in kept.values]
    unpack, pack, values, maps = kept.unpack, kept.pack, kept.values, dict(kept.maps)
    from pyspark.sql.streaming import StatefulProcessor

    class Fold(StatefulProcessor):  # here, so that it travels with the plan
        def init(self, handle):
            self.handle = handle
            self.values = [handle.getValueState(p.split()[0], p) for p in values]
            self.maps = {name: handle.getMapState(name, *kinds) for name, kinds in maps.items()}

        def read(self):
            flat = {c: v.get()[0] for c, v in zip(columns, self.values) if v.exists()}
            return flat | {name: {k[0]: tuple(v) for k, v in m.iterator()} if m.exists() else {} for name, m in self.maps.items()}

        def write(self, before, now):
            for c, v in zip(columns, self.values):
                if now.get(c) != before.get(c):
                    v.update((now.get(c),))
            for name, m in self.maps.items():
                old, new = before[name], now.get(name, {})
                for k, v in new.items():
                    if k not in old or old[k] != v:
                        m.updateValue((k,), v)
                for k in old.keys() - new.keys():
                    m.removeKey((k,))

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            pdf = pd.concat(list(rows)).sort_values(order, na_position="first", kind="stable")
            last, flat = int(pdf[at].max().timestamp() * 1000), self.read()
            before = {c: dict(v) if isinstance(v, dict) else v for c, v in flat.items()}
            held = unpack(flat | {"key_": key})
            got = [r for row in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False) for r in step(held, row)]
            self.write(before, pack(held))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(max(last + ttl_s * 1000, timerValues.getCurrentWatermarkInMs() + 1))
            yield pd.DataFrame(got, columns=names)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import pandas as pd

            got = step(unpack(self.read() | {"key_": key}), None)
            for v in (*self.values, *self.maps.values()):
                v.clear()
            yield pd.DataFrame(got, columns=names)

        def close(self):
            pass

    return stream.withWatermark(at, late).groupBy(*key).transformWithStateInPandas(Fold(), out, "append", "EventTime")


def link_changes(stream: DataFrame, at: str = "at") -> DataFrame:
    """Link states (camera_id, event_id, state, at) that differ from the camera's last."""

    def step(held, row):
        if row is None or held.get("state", "") == row.state:
            return []
        held["state"] = row.state
        return [(row.camera_id, row.event_id, row.state)]

    return fold(stream, ["camera_id"], step, "camera_id string, event_id bigint, state string", ["event_id"], at, Kept(("state string",)), ttl_s=DAY_S)


LINK_STATE = Kept(("down bigint", "drops array<bigint>"), {"last": ("finding string", "at_s bigint")}, lambda flat: flat | {"last": {k: v[0] for k, v in flat["last"].items()}}, lambda held: held | {"last": {k: (v,) for k, v in held["last"].items()}})


def link_findings(stream: DataFrame, at: str = "at", late: str = "10 seconds", **limits) -> DataFrame:
    """Findings of changed link states (camera_id, event_id, at_s, state, at), as `links.findings`."""
    return fold(stream, ["camera_id"], links.found(**limits), links.FOUND, ["event_id", "at_s", "state"], at, LINK_STATE, late, DAY_S)


def _alerts(stream: DataFrame, place: Callable, confirm: int, cooldown_ms: int, forget_ms: int, at: str) -> DataFrame:
    """Alerts of tracks: place(row) is where the track is watched, or None; the confirm-th row in a row there fires, then those after
    the cooldown or of a higher severity than last fired."""
    ranks = dict(RANKS)

    def step(held, row):
        if row is None:
            return []
        now, here = int(row.stream_ms), place(row)
        if "seen" in held and now - held["seen"] > forget_ms:
            held.clear()
        fired, name = held.setdefault("fired", {}), None if here is None else here[-1]
        held["run"] = held.get("run", 0) + 1 if held.get("here") == name and "seen" in held else 1
        held |= {"seen": now, "here": name}
        if here is None or held["run"] < confirm:
            return []
        last, rank = fired.get(name), ranks[row.severity]
        if not here[0] or last and now - last[0] < cooldown_ms and rank <= last[1]:
            return []
        fired[name] = (now, rank)
        return [(row.camera_id, row.track_id, row.event_id, now, row.severity)]

    return fold(stream, ["camera_id", "track_id"], step, "camera_id string, track_id bigint, event_id bigint, stream_ms bigint, severity string", ["k"], at, Kept(("seen bigint", "run bigint", "here string"), {"fired": ("zone string", "at_ms bigint, severity int")}))


def fence_alerts(stream: DataFrame, kinds=("RESTRICTED",), confirm: int = 3, cooldown_ms: int = 30_000, forget_ms: int = 60_000, at: str = "at") -> DataFrame:
    """Alerts of scored rows (camera_id, track_id, event_id, k, stream_ms, zone, zone_kind, severity, at), as in batch."""
    return _alerts(stream, lambda r: None if r.zone is None else (r.zone_kind in kinds, r.zone), confirm, cooldown_ms, forget_ms, at)


def tamper_alerts(stream: DataFrame, confirm: int = 3, cooldown_ms: int = 30_000, forget_ms: int = 60_000, at: str = "at") -> DataFrame:
    """The same for rows (camera_id, track_id, event_id, k, stream_ms, tampering, severity, at) that tamper with the camera."""
    return _alerts(stream, lambda r: (True, "") if r.tampering else None, confirm, cooldown_ms, forget_ms, at)


def suppressed_passes(stream: DataFrame, window_ms: int = 10_000, at: str = "at") -> DataFrame:
    """Passes (pass_key, first_ms, last_ms, at) worth writing: none within window_ms of the last one written of its key."""

    def step(held, row):
        if row is None or "last" in held and row.last_ms - held["last"] < window_ms:
            return []
        held["last"] = row.last_ms
        return [(row.pass_key, row.last_ms)]

    return fold(stream, ["pass_key"], step, "pass_key string, last_ms bigint", ["last_ms", "first_ms"], at, Kept(("last bigint",)))


def track_assign(stream: DataFrame, key: tuple[str, ...] = ("camera_id",), at: str = "at", late: str = "10 seconds", ttl_s: int = 60, **limits) -> DataFrame:
    """Tracks of detections, as `crosscam.assign_tracks`, with a timestamp `at`. A frame comes out when a later one is there or the
    camera has been silent for ttl_s; after such a silence its tracks are numbered from 1 again."""
    d = crosscam.boxes(stream.withColumn("at_", F.col(at)), (*key, "at_"))
    return fold(d, list(key), crosscam.tracked(key, **limits), crosscam.tracks_of(d, key), ["frame", "det_id"], "at_", TRACK_STATE, late, ttl_s)


def _track_state() -> Kept:
    """A tracker's tracks, one entry each with its place among the live or the lost, and the rows of the open frame."""

    def unpack(flat):
        import numpy as np

        t = [{"id": k, "live": live, "seq": seq, "box": tuple(box), "last": last, "hist": None if hist is None else np.array(hist)} for k, (live, seq, box, last, hist) in flat["tracks"].items()]
        live, lost = (sorted((x for x in t if x["live"] == side), key=lambda x: x["seq"]) for side in (True, False))
        rows = [(tuple(flat["key_"]), *r[:3], *r[3], r[4]) for _, r in sorted(flat["open"].items())]
        return {"n": flat.get("n", 0), "next": flat.get("next", 0), "live": live, "lost": lost, "looks": np.array([x["hist"] for x in lost]) if lost else None, "rows": rows}

    def pack(held):
        tracks, n = {}, held["next"]
        for side in ("live", "lost"):
            before = -1
            for x in held[side]:
                if x.get("live") != (side == "live") or x.get("seq", -1) <= before:
                    x |= {"live": side == "live", "seq": n}
                    n += 1
                before = x["seq"]
                tracks[x["id"]] = (x["live"], x["seq"], [float(v) for v in x["box"]], x["last"], None if x["hist"] is None else [float(v) for v in x["hist"]])
        rows = {i: (r[1], r[2], r[3], [float(v) for v in r[4:8]], None if r[8] is None else [float(v) for v in r[8]]) for i, r in enumerate(held["rows"])}
        return {"n": held["n"], "next": n, "tracks": tracks, "open": rows}

    entry = "live boolean, seq bigint, box array<double>, last bigint, hist array<double>"
    return Kept(("n bigint", "next bigint"), {"tracks": ("id bigint", entry), "open": ("i int", "frame bigint, det_id bigint, confidence double, box array<double>, hist array<double>")}, unpack, pack)


TRACK_STATE = _track_state()


def _subjects(flat):
    import numpy as np

    live = [{"id": k, "cameras": set(cameras), "hist": np.array(hist), "last": last} for k, (cameras, hist, last) in sorted(flat["subjects"].items(), key=lambda x: (len(x[0]), x[0]))]
    return {"n": flat.get("n", 0), "live": live}


SUBJECT_STATE = Kept(
    ("n bigint",), {"subjects": ("subject string", "cameras array<string>, hist array<double>, last bigint")}, _subjects,
    lambda held: {"n": held["n"], "subjects": {s["id"]: (sorted(s["cameras"]), [float(x) for x in s["hist"]], s["last"]) for s in held["live"]}},
)


def link_subjects(stream: DataFrame, at: str = "at", late: str = "10 seconds", **limits) -> DataFrame:
    """Subjects of sightings, as `crosscam.link_subjects`, with a timestamp `at` of their begin."""
    return fold(stream, ["post"], crosscam.linked(**limits), crosscam.LINKED, ["first_s", "id"], at, SUBJECT_STATE, late, DAY_S)


def chain(stream: DataFrame, keys: list[str], order: str, at: str = "at", late: str = "10 seconds", days: int = 36_500) -> DataFrame:
    """Rows (event, ts, payload, at) linked to their chains' heads, as `integrity.append`; a head is kept for `days`."""
    rows = stream.select(*keys, order, "event", "ts", "payload")
    linked = integrity.appended()

    def step(held, row):
        return [(*r[:-4], *r[-3:]) for r in linked(held, row)]  # without `at`, which is a row's last column

    return fold(stream.select(*rows.columns, at), keys, step, integrity.chained(rows), [order, "event", "ts", "payload"], at, Kept(("prev string", "seq bigint")), late, days * DAY_S)


def handoff(unread: DataFrame, reads: DataFrame, by: list[str], window: float = 180, similarity: float = 0.55, at: str = "at", late: str = "10 seconds") -> DataFrame:
    """Unread sightings credited with the plate of the first like read by another camera within `window`, as `crosscam.handoff`; both
    streams carry the columns `by`, such as a site, and a timestamp `at`.

    An interval join of two streams under their watermarks: each side is held for as long as the other may still match it. A
    sighting comes out when the watermark has passed all reads that it could be credited with."""
    a = unread.withWatermark(at, late).select(*[F.col(c).alias(f"a_{c}") for c in (*by, "sighting_id", "camera_id", "hist")], F.col(at).alias("seen_at"))
    b = reads.withWatermark(at, late).select(*[F.col(c).alias(f"b_{c}") for c in (*by, "read_id", "camera_id", "hist", "plate", "at_s")], F.col(at).alias("read_at"))
    same = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in by]
    within = [F.col("read_at") >= F.col("seen_at"), F.col("read_at") <= F.col("seen_at") + F.make_dt_interval(secs=F.lit(window)), F.col("a_camera_id") != F.col("b_camera_id")]
    j = a.join(b, reduce(and_, [*same, *within])).withColumn("similarity", V.intersection(F.col("a_hist"), F.col("b_hist"))).where(F.col("similarity") >= similarity)
    read = F.struct(F.col("b_plate").alias("plate"), F.col("b_camera_id").alias("read_by"), F.col("b_at_s").cast("double").alias("at_s"), "similarity")
    got = j.groupBy("seen_at", F.col("a_sighting_id").alias("sighting_id")).agg(F.min_by(read, F.struct("b_at_s", "b_read_id")).alias("b"))
    return got.select("sighting_id", "b.*", F.lit(True).alias("inferred"))


def clip_frames(alerts: DataFrame, frames: DataFrame, pre: int = 40, post_ms: int = 4000, reach_ms: int = 4000, at: str = "at", late: str = "10 seconds") -> DataFrame:
    """Clips of alerts (camera_id, event_id, at_ms, at), as `alerts.clip_frames`, from frames (camera_id, frame_no, at_ms, at) of which
    no two follow each other by more than reach_ms while the camera is on (beyond that, a clip ends with the last frame before).

    An interval join of two streams: frames from reach_ms before an alert to post_ms and reach_ms after it, held under the watermarks
    for as long; a clip comes out when the watermark has passed them all."""
    a = alerts.withWatermark(at, late).select(F.col("camera_id").alias("a_camera"), "event_id", F.col("at_ms").alias("a_ms"), F.col(at).alias("fired_at"))
    f = frames.withWatermark(at, late).select(F.col("camera_id").alias("f_camera"), "frame_no", F.col("at_ms").alias("f_ms"), F.col(at).alias("taken_at"))
    gap = lambda ms: F.make_dt_interval(secs=F.lit(ms / 1000))
    j = a.join(f, (F.col("a_camera") == F.col("f_camera")) & (F.col("taken_at") >= F.col("fired_at") - gap(reach_ms)) & (F.col("taken_at") <= F.col("fired_at") + gap(post_ms + reach_ms)))
    upto, since = F.max(F.when(F.col("f_ms") <= F.col("a_ms"), F.col("frame_no"))), F.min(F.when(F.col("f_ms") >= F.col("a_ms") + post_ms, F.col("frame_no")))
    got = j.groupBy("fired_at", F.col("a_camera").alias("camera_id"), "event_id", F.col("a_ms").alias("at_ms")).agg(upto.alias("own"), since.alias("since"), F.max("frame_no").alias("top"))
    return got.where("own is not null").select("camera_id", "event_id", "at_ms", F.greatest(F.col("own") - (pre - 1), F.lit(1)).alias("first_frame"), F.coalesce("since", "top").alias("last_frame"))


def passes(stream: DataFrame, at: str = "at", gap: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """Passes of each track: sessions without a longer gap."""
    s = stream.withWatermark(at, late).groupBy("camera_id", "track_id", F.session_window(at, gap).alias("w"))
    return s.agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("frames")).drop("w")


def per_minute(stream: DataFrame, at: str = "at", late: str = "10 seconds") -> DataFrame:
    """Alerts of each camera in tumbling minutes."""
    return stream.withWatermark(at, late).groupBy("camera_id", F.window(at, "1 minute").alias("w")).agg(F.count("*").alias("alerts")).select("camera_id", F.col("w.start").alias("minute"), "alerts")


def live_summary(stream: DataFrame) -> DataFrame:
    """Running counts by camera and severity, for update mode."""
    return stream.groupBy("camera_id", "severity").agg(F.count("*").alias("events"), F.max("score").alias("peak"))


def run_once(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """All that is there now, in batches given to `write`; then stop."""
    q = stream.writeStream.outputMode(mode).foreachBatch(lambda b, e: write(b, e) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
