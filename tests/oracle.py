"""The same rows from Spark and from DuckDB."""

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def duck(folder: str = SMALL):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)) or hasattr(x, "is_integer"):
        return repr(round(float(x), 6))
    return str(x)


def same_rows(df, con, sql: str) -> None:
    got = df.collect()
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    ours = sorted(tuple(_cell(r[c]) for c in order) for r in got)
    index = [names.index(c) for c in order]
    theirs = sorted(tuple(_cell(r[i]) for i in index) for r in cur.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs
