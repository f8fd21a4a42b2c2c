"""Compare a registered query with its oracle SQL in DuckDB, as multisets of rows."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def tidy(df):
    def cell(v):
        if v is None or v != v:
            return "~"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return repr(float(v))
        return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)

    cols = sorted(df.columns)
    return sorted(map(tuple, df[cols].map(cell).values.tolist())), cols


def same(spark, sf_dir: str, query, sql: str) -> None:
    got, want = tidy(query(spark, sf_dir).toPandas()), tidy(connect(sf_dir).execute(sql).df())
    assert got[1] == want[1]
    assert len(got[0]) == len(want[0])
    assert got[0] == want[0]
