"""The SQL of plate repair and its Spark form on texts that the tables do not have."""

import random

import duckdb
import pandas as pd

from wardline.functions import plates as P
from wardline.plans import vehicles


def texts(n: int) -> list[str | None]:
    """Valid numbers with up to four characters replaced, dropped or added, and a few odd ones."""
    rnd, odd = random.Random(7), [None, "", " ", "TAXI", "22BH1234AA", "2Z8H1234AA", "MH12AB1234\n", "é" * 9, "DL1CAB1234", "0L1CAB1234", "A" * 40]
    out = list(odd)
    while len(out) < n:
        state, mid = rnd.choice(P.STATES), "".join(rnd.choices("ABCDEFGHJKLMNPRSTUVWXYZ", k=rnd.randint(0, 3)))
        plate = rnd.choice([f"{state}{rnd.randint(1, 99)}{mid}{rnd.randint(0, 9999):04}", f"{rnd.randint(10, 99)}BH{rnd.randint(0, 9999):04}{'ABCD'[: rnd.randint(1, 2)]}"])
        for _ in range(rnd.randint(0, 4)):
            i, c = rnd.randrange(len(plate)), rnd.choice("0123456789OQDUILJZASGTBHMKNXRPCV -")
            plate = plate[:i] + rnd.choice([c, c, c, "", c + plate[i]]) + plate[i + 1 :] or c
        out.append(plate.lower() if rnd.random() < 0.1 else plate)
    return out


def test_repair_equals_sql(spark):
    rows = pd.DataFrame({"raw": sorted(set(texts(6000)) - {None}) + [None]})
    got = P.normalised(spark.createDataFrame(rows, "raw string"), "raw").toPandas()
    c = duckdb.connect()
    c.register("given", rows)
    c.execute("CREATE TABLE fx_ocr AS SELECT CAST(raw AS VARCHAR) AS raw, 50 AS ocr_conf_pct, 1000 AS stream_ms FROM given")
    want = dict(c.execute(f"WITH {vehicles.NM} SELECT raw, plate FROM nm").fetchall())
    mine = dict(zip(got["raw"].where(got["raw"].notna(), None), got["plate"].where(got["plate"].notna(), None), strict=True))
    assert mine == want
    assert 0.3 < sum(v is not None for v in mine.values()) / len(mine) < 0.95
    assert sum(v is not None and v != (k or "").upper() for k, v in mine.items()) > 500
