"""Schemas and policies. Every threshold is a field of a policy and can be changed by the caller."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Detectable classes (id, label, category, weight on a zone's base risk).
CLASSES = (
    (0, "PERSON", "PERSON", 1.00), (1, "BICYCLE", "VEHICLE", 0.85), (3, "MOTORCYCLE", "VEHICLE", 1.00),
    (2, "CAR", "VEHICLE", 1.10), (7, "TRUCK", "VEHICLE", 1.20), (5, "BUS", "VEHICLE", 1.20),
)
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")

BOX = T.StructType([T.StructField(c, T.IntegerType()) for c in ("x1", "y1", "x2", "y2")])
DETECTIONS = T.StructType([
    T.StructField("camera_id", T.StringType()), T.StructField("frame_index", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("stream_s", T.DoubleType()), T.StructField("label", T.StringType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("bbox", BOX), T.StructField("track_id", T.LongType()),
])


@dataclass(frozen=True)
class Zone:
    """A named polygon of a camera (of all cameras if camera_id is None), vertices in 0..1."""

    name: str
    kind: str
    base_risk: int
    polygon: tuple[tuple[float, float], ...]
    objects: tuple[str, ...] = ("PERSON", "VEHICLE")
    camera_id: str | None = None
    description: str = ""

    #: Which kind wins where zones overlap.
    PRIORITY = {"RESTRICTED": 3, "WATCH": 2, "PATROL": 1}

    @property
    def priority(self) -> int:
        return self.PRIORITY.get(self.kind, 0)


@dataclass(frozen=True)
class Policy:
    """Thresholds of context, behaviour, risk and alerts."""

    # The defaults are those that results are compared at.
    history: int = 24
    forget_s: float = 60.0
    still_speed: float = 0.01
    still_speed_mps: float = 0.25
    approach_epsilon: float = 0.01
    near_ratio: float = 0.55
    clip_ratio: float = 0.995
    min_step: float = 1e-4
    alert_kinds: tuple[str, ...] = ("RESTRICTED",)
    loiter_after: float = 5.0
    loiter_per_s: float = 1.5
    loiter_cap: int = 20
    approach_rows: int = 5
    approach_points: int = 8
    erratic_variance: float = 0.45
    erratic_samples: int = 8
    erratic_points: int = 6
    night_move_points: int = 4
    fast_person_mps: float = 2.0
    fast_vehicle_mps: float = 11.0
    fast_points: int = 6
    tamper_ratio: float = 0.65
    tamper_points: int = 30
    camera_growth: float = 0.06
    camera_ratio: float = 0.35
    camera_points: int = 10
    night_from: int = 18
    night_to: int = 6
    zoneless_base: int = 45
    pivot: float = 0.60
    gain: float = 50.0
    confidence_cap: int = 10
    night_bonus: int = 6
    severity: tuple[int, int, int] = (90, 65, 40)
    confirm: int = 3
    cooldown_s: float = 30.0
    watchlisted_points: int = 45
    mismatch_points: int = 35
    unregistered_points: int = 5
    authorised_points: int = -45
    unrecognised_points: int = 0
    flagged: tuple[str, ...] = field(default=("STOLEN", "BLACKLISTED", "WANTED", "SUSPENDED", "IMPOUNDED"))


DEFAULT = Policy()
