"""A hash chain over the event log, in as many chains as there are keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators import folds

GENESIS = "0" * 64


def link(prev: Column, event: Column, ts: Column, payload: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", prev, event, ts, payload).cast("binary"), 256)


def append(rows: DataFrame, chain: list[str], order: str, head: str = GENESIS) -> DataFrame:
    """rows (event, ts, payload as text) with prev_hash, hash and seq. Each chain is folded in order, with its head alone kept."""
    rows = rows.select(*chain, order, "event", "ts", "payload")
    return folds.in_order(rows, chain, [order, "event", "ts", "payload"], appended(head), chained(rows))


def chained(rows: DataFrame) -> str:
    """The schema of rows of a chain."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return f"{schema}, prev_hash string, hash string, seq bigint"


def appended(head: str = GENESIS):
    """The step of a chain's fold: the row with the head before it and its own hash."""
    from hashlib import sha256

    def step(held, r):
        if r is None:
            return []
        before, seq = held.get("prev", head), held.get("seq", 0) + 1
        mine = sha256("\x1f".join(x for x in (before, r.event, r.ts, r.payload) if x is not None).encode()).hexdigest()
        held |= {"prev": mine, "seq": seq}
        return [(*r, before, mine, seq)]

    return step


def verify(stored: DataFrame, chain: list[str], order: str = "seq") -> DataFrame:
    """Every break of the stored chains: rows (chain, event, break). A row may break in two ways. A row without hashes cannot be
    verified and carries the head before it on (or its own hash, if it has one)."""
    w = Window.partitionBy(*chain).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    s = stored.withColumn("_prev", F.coalesce(F.last("hash", ignorenulls=True).over(w), F.lit(GENESIS)))
    bare = F.col("hash").isNull() | F.col("prev_hash").isNull()
    found = F.filter(F.array(
        F.when(bare, "unchained"), F.when(~bare & (F.col("prev_hash") != F.col("_prev")), "previous changed or removed"),
        F.when(~bare & (link(F.col("prev_hash"), F.col("event"), F.col("ts"), F.col("payload")) != F.col("hash")), "contents changed"),
    ), lambda x: x.isNotNull())
    return s.select(*chain, "event", F.explode(found).alias("break"))


def append_days(rows: DataFrame, chain: list[str], day: str, order: str, heads: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Two levels: rows (chain, day, order, event, ts, payload) linked within a chain and day, and a chain of the days' heads.

    The rows' links are as those of `append`, each day from the beginning, so days are folded in parallel. heads: (chain, day, event, ts,
    payload, prev_hash, hash, seq), a row for each day: event is the hash of its last row, ts how many rows it has. They go on
    from `heads` of earlier days, if given. Only heads, one a day, are folded by chain.

    Proof of inclusion: a row is in the log that the newest head stands for if the rows of its day from it on, and the heads from its
    day on, link up to that head (`proof`, `proven`).
    """
    linked = append(rows, [*chain, day], order)
    return linked, head_chain(day_heads(linked, chain, day), chain, day, heads)


def day_heads(linked: DataFrame, chain: list[str], day: str) -> DataFrame:
    """The day's last hash (event), number of rows (ts) and name (payload), as text."""
    last = linked.groupBy(*chain, day).agg(F.max_by("hash", "seq").alias("event"), F.count("*").cast("string").alias("ts"))
    return last.withColumn("payload", F.col(day).cast("string"))


def head_chain(days: DataFrame, chain: list[str], day: str, heads: DataFrame | None = None) -> DataFrame:
    """Heads of days linked to those before them."""
    new = days.select(*chain, day, "event", "ts", "payload")
    if heads is None:
        return append(new, chain, day)
    known = heads.groupBy(*chain).agg(F.max_by(F.struct("hash", "seq", F.col(day).alias("to")), day).alias("top"))
    early = new.join(known, chain).where(F.col(day) <= F.col("top.to"))
    if not early.isEmpty():
        raise ValueError("a day before a chain's newest head cannot be added; its rows would change what is proven")
    tops = known.select(*chain, F.col("top.to").alias(day), F.col("top.hash").alias("hash"), F.col("top.seq").alias("seq"))
    rows = new.select(*chain, day, "event", "ts", "payload", F.lit(None).cast("string").alias("hash"), F.lit(None).cast("long").alias("seq"))
    begun = tops.select(*chain, day, F.lit(None).cast("string").alias("event"), F.lit(None).cast("string").alias("ts"), F.lit(None).cast("string").alias("payload"), "hash", F.col("seq").cast("long").alias("seq"))
    step = appended()

    def resumed(held, r):
        if r is not None and r.hash is not None:
            held |= {"prev": r.hash, "seq": r.seq}
            return []
        return [(*x[:-5], *x[-3:]) for x in step(held, r)]

    both = begun.unionByName(rows)
    return folds.in_order(both, chain, [day], resumed, chained(new)).unionByName(heads.select(*chained_columns(new)))


def chained_columns(rows: DataFrame) -> list[str]:
    return [*rows.columns, "prev_hash", "hash", "seq"]


def verify_days(linked: DataFrame, heads: DataFrame, chain: list[str], day: str) -> DataFrame:
    """Every break of both levels: rows (chain, day, event, break), event being null where a day is at fault. Days are verified in parallel,
    and against their heads: a day that was removed, added or cut short at its end shows there."""
    rows = verify(linked, [*chain, day]).select(*chain, day, "event", "break")
    top = verify(heads, chain, day).select(*chain, F.col("event").alias("_head"), "break")
    top = heads.select(*chain, day, F.col("event").alias("_head")).join(top, [*chain, "_head"]).select(*chain, day, F.lit(None).cast("string").alias("event"), F.concat(F.lit("head: "), "break").alias("break"))
    now = day_heads(linked, chain, day).select(*chain, day, F.col("event").alias("_last"), F.col("ts").alias("_rows"))
    both = heads.select(*chain, day, F.col("event").alias("_head"), "ts").join(now, [*chain, day], "full")
    fault = F.when(F.col("_head").isNull(), "day without a head").when(F.col("_last").isNull(), "day removed").when(~(F.col("_head").eqNullSafe(F.col("_last")) & F.col("ts").eqNullSafe(F.col("_rows"))), "day does not end as its head says")
    days = both.select(*chain, day, F.lit(None).cast("string").alias("event"), fault.alias("break")).where("break is not null")
    return rows.unionByName(top).unionByName(days)


def proof(linked: DataFrame, heads: DataFrame, chain: dict[str, object], day: str, of: object, event: str) -> list[tuple]:
    """What proves that an event of a chain (column values) and day is in the log: (event, ts, payload, prev_hash, hash) of the rows of its day
    from it on, and of the heads from its day on. As long as a day has rows and the chain has days since."""
    for c, v in chain.items():
        linked, heads = linked.where(F.col(c) == v), heads.where(F.col(c) == v)
    cols = ["event", "ts", "payload", "prev_hash", "hash"]
    rows = linked.where(F.col(day) == of)
    at = rows.where(F.col("event") == event).agg(F.min("seq")).first()[0]
    days = heads.where(F.col(day) >= of).orderBy("seq").select(*cols).collect()
    return [[tuple(r) for r in rows.where(F.col("seq") >= at).orderBy("seq").select(*cols).collect()], [tuple(r) for r in days]]


def proven(steps: list, event: str, newest: str) -> bool:
    """Whether a proof leads from an event to the newest head's hash."""
    from hashlib import sha256

    rows, days = steps
    digest = lambda r: sha256("\x1f".join(x for x in (r[3], *r[:3]) if x is not None).encode()).hexdigest()
    whole = all(digest(r) == r[4] for r in (*rows, *days)) and all(b[3] == a[4] for part in (rows, days) for a, b in zip(part, part[1:]))
    return bool(rows and days) and rows[0][0] == event and whole and days[0][0] == rows[-1][4] and days[-1][4] == newest
