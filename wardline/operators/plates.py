"""From plate reads to plate numbers: candidates, consensus, registry, passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import plates as P
from wardline.model import DEFAULT, Policy
from wardline.operators import folds

# Registry wordings of each class.
ALIASES = {
    "MOTORCYCLE": ("MOTORCYCLE", "MOTOR CYCLE", "M-CYCLE", "MCWG", "SCOOTER", "TWO WHEELER", "2W"),
    "CAR": ("CAR", "MOTOR CAR", "LMV", "LMV-CAR", "JEEP", "SUV", "TAXI", "FOUR WHEELER"),
    "TRUCK": ("TRUCK", "GOODS", "GOODS CARRIER", "HGV", "HMV", "LGV", "TRAILER", "TANKER"),
    "BUS": ("BUS", "OMNIBUS", "OMNI BUS", "PSV", "STAGE CARRIAGE", "MINIBUS"),
    "BICYCLE": ("BICYCLE", "CYCLE", "NON-MOTORISED"),
}


def canonical_class(raw: Column) -> Column:
    """Detector class of a registry wording, null if unknown."""
    text, out = F.upper(F.trim(raw)), None
    for name, words in ALIASES.items():
        out = F.when(text.isin(*words), name) if out is None else out.when(text.isin(*words), name)
    return out


def sure(confidence: Column, sharpness: Column) -> Column:
    return (confidence >= 0.12) & (sharpness >= 45)


def accept(reads: DataFrame, raw: str = "raw", confidence: str = "confidence", sharpness: str = "sharpness") -> DataFrame:
    """Reads that normalise (column plate), of enough confidence and sharpness."""
    return P.normalised(reads.where(sure(F.col(confidence), F.col(sharpness))), raw).where("plate is not null")


def first_texts(reads: DataFrame, order: str = "k", raw: str = "raw", confidence: str = "confidence", sharpness: str = "sharpness") -> DataFrame:
    """What `first_plates` needs of the reads that `accept` keeps: of each text of a track when it was first read, with its plate, null
    where it is none. A text that a track repeats is normalised once."""
    seen = reads.where(sure(F.col(confidence), F.col(sharpness))).groupBy("camera_id", "track_id", raw, "label").agg(F.min(order).alias(order))
    return P.normalised(seen, raw).drop(raw)


def consensus(reads: DataFrame, key: list[str], plate: str, order: str, min_reads: int = 2) -> DataFrame:
    """Rows (key, consensus, reads): the plate voted for character by character, null where a position ties or reads are too few.

    Only the length with most votes counts (the one seen first on a tie). Votes are pre-aggregated to distinct texts.
    """
    votes = reads.groupBy(*key, plate).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    lengths = votes.groupBy(*key, F.length(plate).alias("_len")).agg(F.sum("_n").alias("_reads"), F.min("_first").alias("_first"))
    best = lengths.groupBy(*key).agg(F.max_by(F.struct("_len", "_reads"), F.struct(F.col("_reads"), -F.col("_first"))).alias("_b")).select(*key, "_b._len", "_b._reads")
    chars = votes.join(best, key).where((F.length(plate) == F.col("_len")) & (F.col("_reads") >= min_reads))
    chars = chars.select(*key, "_n", F.posexplode(F.split(plate, "")).alias("_pos", "_ch")).groupBy(*key, "_pos", "_ch").agg(F.sum("_n").alias("_n"))
    top = chars.groupBy(*key, "_pos").agg(F.max(F.struct("_n", "_ch")).alias("_t"), F.sort_array(F.collect_list("_n"), asc=False).alias("_ns"))
    top = top.withColumn("_clear", (F.size("_ns") == 1) | (F.get("_ns", F.lit(0)) > F.get("_ns", F.lit(1))))
    merged = top.groupBy(*key).agg(F.min("_clear").alias("_ok"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", F.col("_t._ch").alias("_ch")))), lambda x: x["_ch"]), "").alias("_text"))
    return best.join(merged, key, "left").select(*key, F.when(F.col("_ok"), F.col("_text")).alias("consensus"), F.col("_reads").alias("reads"))


def unconfirmed(reads: DataFrame, agreed: DataFrame, key: list[str], plate: str, top: int = 3) -> DataFrame:
    """The most frequent texts of keys without a consensus, at most `top` of each."""
    open_ = agreed.where("consensus is null").select(*key)
    w = Window.partitionBy(*key).orderBy(F.desc("n"), plate)
    votes = reads.join(open_, key, "left_semi").groupBy(*key, plate).agg(F.count("*").alias("n"))
    return votes.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= top)


def fleet(reads: DataFrame, plate: str = "plate", at: str = "at_s", confidence: str = "confidence") -> DataFrame:
    """Plates pooled over cameras: reads, best confidence, last time, cameras in order of first read, first reader."""
    per = reads.groupBy(plate, "camera_id").agg(F.count("*").alias("n"), F.max(confidence).alias("c"), F.max(at).alias("last"), F.min(F.struct(at, "event_id")).alias("first"))
    out = per.groupBy(plate).agg(F.sum("n").alias("reads"), F.max("c").alias("confidence"), F.max("last").alias("last_s"), F.transform(F.array_sort(F.collect_list(F.struct("first", "camera_id"))), lambda x: x["camera_id"]).alias("cameras"))
    return out.withColumn("first_read_by", F.get("cameras", F.lit(0)))


def first_plates(own: DataFrame, fleet: DataFrame, order: str = "k") -> DataFrame:
    """The plate that a track is checked by, for good: the first that is known of it, its own read before the fleet's of the same
    moment. own, fleet: rows (camera_id, track_id, order, plate, label). Rows (camera_id, track_id, plate, label, from_k, inferred).

    Rows without a plate have no place in the order; a filter on the plate would be moved to the reads and normalise each of them again."""
    both = own.withColumn("inferred", F.lit(False)).unionByName(fleet.withColumn("inferred", F.lit(True)), allowMissingColumns=True)
    place = F.when(F.col("plate").isNotNull(), F.struct(order, "inferred", "plate"))
    first = both.groupBy("camera_id", "track_id").agg(F.min_by(F.struct("plate", "label", F.col(order).alias("from_k"), "inferred"), place).alias("b"))
    return first.where("b is not null").select("camera_id", "track_id", "b.*")


def best_reading(reads: DataFrame, agreed: DataFrame, key: list[str], plate: str = "plate", raw: str = "raw", order: str = "k") -> DataFrame:
    """agreed (consensus of reads) with the confidence and raw text of the surest read of that text, the first of equals; if it was
    never read as such, of the text of its length with most reads, the first seen on a tie. Null where there is no consensus."""
    texts = reads.groupBy(*key, F.col(plate).alias("_t")).agg(
        F.count("*").alias("_n"), F.min(order).alias("_f"), F.max("confidence").alias("_c"), F.max_by(raw, F.struct(F.col("confidence"), -F.col(order))).alias("_r"))
    rank = F.struct(F.col("_t") == F.col("consensus"), F.length("_t") == F.length("consensus"), "_n", -F.col("_f"))
    best = agreed.where("consensus is not null").join(texts, key).groupBy(*key).agg(F.max_by(F.struct(F.col("_c").alias("confidence"), F.col("_r").alias("raw")), rank).alias("_b"))
    return agreed.join(best, key, "left").select(*agreed.columns, "_b.confidence", "_b.raw")


def check_registry(seen: DataFrame, registry: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """seen (plate, label, ...) with known, flagged, mismatch, behaviour and points. A class the aliases do not know is never a
    mismatch; a plate the registry does not hold is kept as unknown."""
    r = registry.select(P.clean(F.col("plate")).alias("plate"), "vehicle_class", F.upper(F.coalesce("status", F.lit("ACTIVE"))).alias("status"))
    out = seen.join(r, "plate", "left").withColumn("registered", canonical_class(F.col("vehicle_class")))
    out = out.withColumns({"known": F.col("status").isNotNull(), "flagged": F.coalesce(F.col("status").isin(*policy.flagged), F.lit(False)), "mismatch": F.coalesce(F.col("registered") != F.upper("label"), F.lit(False))})
    name = F.when(F.col("flagged"), "WATCHLISTED VEHICLE").when(F.col("mismatch"), "PLATE MISMATCH").when(~F.col("known"), "UNREGISTERED PLATE")
    points = F.when(F.col("flagged"), policy.watchlisted_points).when(F.col("mismatch"), policy.mismatch_points).when(~F.col("known"), policy.unregistered_points).otherwise(0)
    detail = (
        F.when(~F.col("known"), "not in the registry").when(F.col("flagged"), F.concat(F.lit("registry status "), "status"))
        .when(F.col("mismatch"), F.concat(F.lit("plate is registered to a "), F.lower("registered"), F.lit(", camera sees a "), F.lower("label")))
        .when(F.col("registered").isNull(), F.concat(F.lit("registered class '"), "vehicle_class", F.lit("' not recognised")))
        .otherwise(F.concat(F.lit("matches registration ("), F.lower("registered"), F.lit(")")))
    )
    return out.withColumns({"behaviour": name, "points": points, "detail": detail})


def clean_registry(raw: DataFrame, position: str) -> DataFrame:
    """Registry rows with tidy plates; rows without a plate are skipped, the last of a plate wins."""
    r = raw.withColumn("plate", F.upper(F.regexp_replace(F.coalesce("plate", F.lit("")), " ", ""))).where("plate <> ''")
    w = Window.partitionBy("plate").orderBy(F.desc(position))
    return r.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").withColumn("status", F.upper(F.coalesce("status", F.lit("ACTIVE"))))


def passes(sightings: DataFrame, gap_ms: int = 2000) -> DataFrame:
    """Passes of vehicles: observations of a track none more than gap_ms after the one before, with the best-confidence plate
    (the later of equals) and the sharpest crop (the earlier of equals). Needs stream_ms, k, plate, confidence, sharpness."""
    w = Window.partitionBy("camera_id", "track_id").orderBy("k")
    s = sightings.withColumn("_n", F.when(F.col("stream_ms") - F.lag("stream_ms").over(w) <= gap_ms, 0).otherwise(1)).withColumn("pass_no", F.sum("_n").over(w))
    read = F.when(F.col("plate").isNotNull(), F.struct("confidence", "k"))
    return s.groupBy("camera_id", "track_id", "pass_no").agg(
        F.min("stream_ms").alias("first_ms"), F.max("stream_ms").alias("last_ms"), F.count("*").alias("frames"), F.first("label").alias("label"),
        F.max_by("plate", read).alias("plate"), F.max(F.when(F.col("plate").isNotNull(), F.col("confidence"))).alias("confidence"),
        F.max_by("event_id", F.struct("sharpness", -F.col("k"))).alias("crop_event"),
    )


def pass_log(passes: DataFrame, start) -> DataFrame:
    """Rows of the pass log of `passes`, for `sinks.day_json` by `at`: at, camera_id, track_id, vehicle, plate, display, confidence (of a
    plate only), plate_read, seconds_in_view, frames, crop. start: the time at which the footage began, a timestamp column.
    A pass whose plate was not read says so."""
    at = F.timestamp_millis(F.unix_millis(start) + F.col("first_ms").cast("long"))
    crop = F.concat_ws("-", F.lit("pass"), "camera_id", F.col("track_id").cast("string"))
    return passes.select(
        F.date_trunc("second", at).alias("at"), "camera_id", "track_id", F.col("label").alias("vehicle"), "plate", P.display(F.col("plate")).alias("display"),
        F.when(F.col("plate").isNotNull(), F.bround("confidence", 3)).alias("confidence"), F.col("plate").isNotNull().alias("plate_read"),
        F.bround((F.col("last_ms") - F.col("first_ms")).cast("double") / 1000, 1).alias("seconds_in_view"), "frames", F.when(F.col("crop_event").isNotNull(), crop).alias("crop"),
    )


def suppress(rows: DataFrame, window_ms: int = 10_000) -> DataFrame:
    """Passes worth writing: of one plate (else camera and track) none that ends within window_ms of the last one written."""
    key = F.coalesce("plate", F.concat_ws("#", "camera_id", F.col("track_id").cast("string")))
    rows = rows.withColumn("pass_key", key).withColumn("event_id", F.col("first_ms"))
    return folds.cooldown(rows, ["pass_key"], "last_ms", ["camera_id", "track_id", "pass_no", "frames"], window_ms, tie="first_ms", split=True)


def sample_reads(reads: DataFrame, width: str, area: str, frame: str, plate: str, key: list[str], min_width=180, apart=10, most=12, agree=3, growth=1.15) -> DataFrame:
    """Attempts that a track's reads are worth: wide enough, `apart` frames after the last one, at most `most`; once `agree`
    attempts gave one plate only for a view `growth` times larger than the largest so far. The rows of a key are folded."""
    item = F.struct(F.col(frame).alias("f"), F.col(area).cast("double").alias("area"), F.col(plate).alias("plate"), "event_id")
    rows = reads.where(F.col(width) >= min_width).groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("xs"))
    kind = rows.schema["xs"].dataType.elementType.simpleString()
    zero = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).cast("double").alias("best"), F.array().cast(f"array<{kind}>").alias("kept"))

    def step(a, x):
        same = F.aggregate(a["kept"], F.lit(0), lambda n, y: F.greatest(n, F.size(F.filter(a["kept"], lambda z: F.coalesce(z["plate"] == y["plate"], F.lit(False))))))
        ok = (F.size(a["kept"]) < most) & (a["last"].isNull() | (x["f"] - a["last"] >= apart)) & ((same < agree) | (x["area"] >= growth * a["best"]))
        return F.struct(F.when(ok, x["f"].cast("double")).otherwise(a["last"]).alias("last"), F.when(ok, F.greatest(a["best"], x["area"])).otherwise(a["best"]).alias("best"), F.when(ok, F.concat(a["kept"], F.array(x))).otherwise(a["kept"]).alias("kept"))

    return rows.select(*key, F.explode(F.aggregate("xs", zero, step, lambda a: a["kept"])).alias("x")).select(*key, "x.event_id", F.col("x.f").alias(frame))


def sample_faces(faces: DataFrame, key: list[str], width: str, frame: str, person: str) -> DataFrame:
    """The same for identities: 8 frames apart, at most 10, none after two attempts have recognised one person."""
    return sample_reads(faces, width, width, frame, person, key, min_width=0, apart=8, most=10, agree=2, growth=1e18)


def fragments(reads: DataFrame, image: str = "image", tolerance: float = 0.6) -> DataFrame:
    """Plate candidates of each image's text fragments (text, confidence, top, bottom, left): rows (image, nth, text, confidence).

    Fragments whose middles are close are a row, read left to right; single fragments, whole rows and each row with the one below
    it are candidates. Lengths 8 to 11 come first, then the surer.
    """
    mid, height = (F.col("top") + F.col("bottom")) / 2, F.greatest(F.lit(1.0), F.col("bottom") - F.col("top"))
    item = F.struct(mid.cast("double").alias("mid"), F.col("left").cast("double").alias("left"), P.clean(F.col("text")).alias("text"), F.col("confidence").cast("double").alias("confidence"), height.cast("double").alias("height"))
    got = reads.groupBy(image).agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = got.schema["items"].dataType.elementType.simpleString()

    def placed(rows, x):
        """rows with a fragment in the first whose first fragment is close, or in one of its own."""
        close = F.transform(rows, lambda r: F.abs(r[0]["mid"] - x["mid"]) <= tolerance * x["height"])
        home = F.array_position(close, True)
        return F.when(home == 0, F.concat(rows, F.array(F.array(x)))).otherwise(F.transform(rows, lambda r, i: F.when(i + 1 == home, F.concat(r, F.array(x))).otherwise(r)))

    rows = F.aggregate("items", F.array().cast(f"array<array<{kind}>>"), placed)
    left = lambda r: F.array_sort(F.transform(r, lambda b: F.struct(b["left"].alias("left"), b["mid"].alias("mid"), b["text"].alias("text"), b["confidence"].alias("confidence"))))
    got = got.select(image, F.transform(rows, left).alias("rows"))
    whole = lambda r: F.struct(F.array_join(F.transform(r, lambda b: b["text"]), "").alias("text"), F.array_min(F.transform(r, lambda b: b["confidence"])).alias("confidence"))
    one = F.transform(F.flatten("rows"), lambda b: F.struct(b["text"].alias("text"), b["confidence"].alias("confidence")))
    joined = F.transform(F.filter("rows", lambda r: F.size(r) > 1), whole)
    below = F.transform(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0))), lambda r, i: whole(F.concat(F.col("rows")[i], r)))
    fits = F.filter(F.concat(one, joined, below), lambda c: F.length(c["text"]).between(4, 13) & c["text"].rlike("[0-9]") & c["text"].rlike("[A-Z]"))
    order = F.array_sort(F.transform(fits, lambda c: F.struct((~F.length(c["text"]).between(8, 11)).alias("odd"), (-c["confidence"]).alias("last"), c["text"].alias("text"), c["confidence"].alias("confidence"))))
    return got.select(image, F.posexplode(order).alias("at", "c")).select(image, (F.col("at") + 1).alias("nth"), "c.text", "c.confidence")


def in_vehicle(boxes: DataFrame, vehicles: DataFrame, upper_half: bool = False) -> DataFrame:
    """Boxes of each frame with the vehicle (or person) box that holds their centre, bounds included; the surest box of each.

    boxes: camera_id, frame, box_id, confidence, x1, y1, x2, y2; vehicles: camera_id, frame, vehicle_id, vx1, vy1, vx2, vy2.
    """
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    bottom = F.when(F.lit(upper_half), (F.col("vy1") + F.col("vy2")) / 2).otherwise(F.col("vy2"))
    j = boxes.join(vehicles, ["camera_id", "frame"]).where(cx.between(F.col("vx1"), F.col("vx2")) & cy.between(F.col("vy1"), bottom))
    return j.groupBy("camera_id", "frame", "vehicle_id").agg(F.max_by("box_id", F.struct("confidence", -F.col("box_id"))).alias("box_id"), F.max("confidence").alias("confidence"))
