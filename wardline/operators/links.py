"""Camera links: outages, drops and what they suggest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators import folds

# Finding and points.
POINTS = {"CAMERA LINK LOST": 40, "CAMERA OFFLINE": 55, "REPEATED LINK LOSS": 15}


def changes(states: DataFrame, order: str = "event_id") -> DataFrame:
    """Link states that differ from the camera's last one."""
    w = Window.partitionBy("camera_id").orderBy(order)
    return states.withColumn("_p", F.lag("state").over(w)).where(~F.col("state").eqNullSafe(F.col("_p"))).drop("_p")


def outages(changed: DataFrame, at: str = "at_s", order: str = "event_id") -> DataFrame:
    """Rows (camera_id, down_s, up_s, seconds, ended_as): from the first RECONNECTING since the link was last up or given up to
    the next ONLINE or OFFLINE; still open outages have no end."""
    w = Window.partitionBy("camera_id").orderBy(order)
    c = changed.withColumn("_up", F.coalesce(F.sum(F.col("state").isin("ONLINE", "OFFLINE").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    g = c.groupBy("camera_id", "_up").agg(
        F.min(F.when(F.col("state") == "RECONNECTING", F.col(at))).alias("down_s"), F.max(F.when(F.col("state") != "RECONNECTING", F.col(at))).alias("up_s"), F.max(F.when(F.col("state") != "RECONNECTING", F.col("state"))).alias("ended_as"))
    return g.where("down_s is not null").select("camera_id", "down_s", "up_s", (F.col("up_s") - F.col("down_s")).alias("seconds"), "ended_as")


def drops(found: DataFrame, window_s: int = 300) -> DataFrame:
    """Outages with recent: how many began in the window_s seconds that end with this one's begin."""
    w = Window.partitionBy("camera_id").orderBy("down_s").rangeBetween(-window_s, 0)
    return found.withColumn("recent", F.count("*").over(w))


FOUND = "camera_id string, event_id bigint, at_s bigint, finding string, points int"


def findings(changed: DataFrame, at: str = "at_s", order: str = "event_id", grace=10, window=300, repeats=3, cooldown=60) -> DataFrame:
    """Rows (camera_id, event_id, at_s, finding, points) that the link states of each camera give rise to.

    A restored outage of `grace` seconds, a link given up, and `repeats` drops within `window` seconds are findings; each is
    silent for `cooldown` seconds after it was last raised. A link given up in that time leaves its outage open. The states
    of a camera are folded in order; the drops of the last `window` seconds are kept.
    """
    rows = changed.select("camera_id", F.col(order).cast("long").alias("event_id"), F.col(at).cast("long").alias("at_s"), "state")
    return folds.in_order(rows, ["camera_id"], ["event_id", "at_s", "state"], found(grace, window, repeats, cooldown), FOUND)


def found(grace=10, window=300, repeats=3, cooldown=60):
    """The step of a camera's fold over its link states (camera_id, event_id, at_s, state)."""
    points = dict(POINTS)

    def step(held, row):
        if row is None:
            return []
        now, names, last, down, drops = row.at_s, [], held.setdefault("last", {}), held.get("down"), held.get("drops", [])

        def raised(name):
            if name in last and now - last[name] < cooldown:
                return False
            last[name] = now
            names.append(name)
            return True

        counts = row.state in ("RECONNECTING", "ONLINE", "OFFLINE")
        if row.state == "RECONNECTING" and down is None:
            down = now
            drops = [*drops, now]
        elif row.state == "ONLINE":
            counts = down is not None
            if counts and now - down >= grace:
                raised("CAMERA LINK LOST")
            down = None
        elif row.state == "OFFLINE":
            counts = raised("CAMERA OFFLINE")
            down = None if counts else down
        if counts:
            drops = [t for t in drops if now - t <= window]
            if len(drops) >= repeats:
                raised("REPEATED LINK LOSS")
        held |= {"down": down, "drops": drops}
        return [(row.camera_id, row.event_id, now, n, points[n]) for n in names]

    return step
