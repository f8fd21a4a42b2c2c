"""Rules whose next output depends on their last one, folded over each key's rows inside Catalyst or in sorted batches."""

from __future__ import annotations

from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def in_order(rows: DataFrame, key: list[str], order: list[str], step, schema: str) -> DataFrame:
    """Rows of `schema` from a fold over each key's rows in order, nulls first. step(held, row) takes the key's state, a dict that is
    empty at first, and a row (a named tuple of rows' columns), or None after the key's last, and returns a list of output rows.

    Spark sorts the rows, on disk if need be, and they come in batches: a task holds a batch and one key's state, however
    many rows the key has.
    """
    names, made = rows.columns, to_arrow_schema(T.StructType.fromDDL(schema))

    def work(batches):
        from collections import namedtuple

        kind = namedtuple("Row", names, rename=True)
        at = [names.index(k) for k in key]
        last = held = None

        def packed(out):
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(made), made, strict=True)], schema=made)

        for batch in batches:
            out = []
            for r in zip(*map(values, batch.columns), strict=True):
                now = [r[i] for i in at]
                if held is None or now != last:
                    if held is not None:
                        out += step(held, None)
                    last, held = now, {}
                out += step(held, kind(*r))
            yield packed(out)
        if held is not None:
            yield packed(step(held, None))

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(work, schema)


def values(column: pa.Array):
    """A column's values as Python ones; lists of doubles as arrays, with NaN for null. Whole columns are turned at once where they can be,
    which takes a fraction of the time."""
    t = column.type
    if not column.null_count and (pa.types.is_integer(t) or pa.types.is_floating(t)):
        return column.to_numpy(zero_copy_only=False).tolist()
    if pa.types.is_list(t) and pa.types.is_float64(t.value_type):
        flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy().tolist()
        return [flat[a:b] if ok else None for a, b, ok in zip(ends, ends[1:], column.is_valid().to_pylist())]
    return column.to_pylist()


def segments(rows: DataFrame, key: list[str], at: str, until: str, reach: int, name: str = "segment_", touch: bool = False) -> DataFrame:
    """rows with the number of their segment: a key's rows in order of `at` are cut where all before ended (`until`, not before `at`)
    more than `reach` ago (with touch, `reach` or more). What a fold remembers for no longer than that does not cross a cut, so segments are folded in parallel.

    No cut falls between rows that are within `reach` of each other, so rows are first summed to one a stretch of that width, and
    only those, a few numbers each, are ordered by key.
    """
    width = max(1, reach)
    rows = rows.withColumn("_cell", F.floor(F.col(at) / width))
    cells = rows.groupBy(*key, "_cell").agg(F.min(at).alias("_first"), F.max(F.greatest(at, until)).alias("_last"))
    w = Window.partitionBy(*key).orderBy("_cell")
    before = F.max("_last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumn("_cut", F.when(F.col("_first") - before >= reach if touch else F.col("_first") - before > reach, 1).otherwise(0)).withColumn(name, F.sum("_cut").over(w))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*key, "_cell")]
    return rows.alias("l").join(cells.alias("r"), reduce(and_, same)).select(*[F.col(f"l.{c}") for c in rows.columns if c != "_cell"], F.col(f"r.{name}").alias(name))


def numbered(folded: DataFrame, key: list[str], number: str, name: str = "segment_") -> DataFrame:
    """Rows of a fold over segments, each of which counted from 1, with `number` counted through over all of a key: each segment goes
    on from the sum of those before it. folded is read twice, so pass it in cut."""
    w = Window.partitionBy(*key).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    sums = folded.groupBy(*key, name).agg(F.max(number).alias("_most")).withColumn("_before", F.coalesce(F.sum("_most").over(w), F.lit(0)))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*key, name)]
    got = folded.alias("l").join(sums.alias("r"), reduce(and_, same))
    return got.select(*[(F.col(f"l.{c}") + F.col("r._before")).alias(c) if c == number else F.col(f"l.{c}") for c in folded.columns if c != name])


def cooldown(rows: DataFrame, key: list[str], time: str, carry: list[str], wait, rank: str | None = None, tie: str = "event_id", split: bool = False) -> DataFrame:
    """The rows that fire, with key, time and carry: a key's first row, then every row at least `wait` after its last fire, or
    of a higher rank than that fire had. Rows of equal time go by tie; rows without a time never fire. The rank remembered is that
    of the last fire, whatever it was.

    The rows of a key are sorted by Spark and come in batches, of which a task holds one and the key's last fire; from each fire it
    goes on to the next, over the rows between. With split, a key is cut where nothing happened for `wait`, after which a row
    fires whatever came before, and the pieces are worked on in parallel.
    """
    cols = list(dict.fromkeys([time, tie, *carry, *([rank] if rank else [])]))
    rows = rows.select(*key, *[c for c in cols if c not in key]).where(F.col(time).isNotNull())
    own = list(key)
    if split:
        rows, own = segments(rows, key, time, time, wait, touch=True), [*key, "segment_"]
    names, made = rows.columns, rows.schema

    def work(batches):
        import numpy as np
        import pyarrow.compute as pc

        last = at = level = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for k in own:
                c = batch.column(k)
                a, b = c.slice(1), c.slice(0, n - 1)
                new[1:] |= pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)
            first = [batch.column(k)[0].as_py() for k in own]
            new[0] = last is None or first != last
            last = [batch.column(k)[n - 1].as_py() for k in own]
            times = batch.column(time).cast(pa.float64()).to_numpy(zero_copy_only=False)
            ranks = batch.column(rank).fill_null(-1).to_numpy(zero_copy_only=False) if rank else None
            starts, fired = np.flatnonzero(new).tolist(), []
            for s, e in zip(starts if new[0] else [0, *starts], [*(starts[1:] if new[0] else starts), n], strict=True):
                i = s
                if new[s]:
                    fired.append(s)
                    at, level, i = times[s], ranks[s] if rank else 0, s + 1
                while i < e:
                    j = i + int(np.searchsorted(times[i:e], at + wait))
                    if rank and (up := np.flatnonzero(ranks[i:j] > level)[:1]).size:
                        j = i + int(up[0])
                    if j < e:
                        fired.append(j)
                        at, level = times[j], ranks[j] if rank else 0
                    i = j + 1
            yield batch.take(pa.array(fired, pa.int64()))

    out = rows.repartition(*own).sortWithinPartitions(*own, time, tie).mapInArrow(work, made)
    return out.select(*[c for c in names if c != "segment_"])
