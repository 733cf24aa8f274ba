"""A Spark result against SQL on the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def canonical(frame):
    columns = sorted(frame.columns)

    def cell(v):
        if v is None or str(v) in ("<NA>", "NaT", "nan"):
            return "NULL"
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        if hasattr(v, "__float__") and not isinstance(v, str):
            return repr(round(float(v), 6) + 0.0)
        return str(v)

    return columns, sorted(tuple(cell(v) for v in row) for row in frame[columns].itertuples(index=False, name=None))


def same(df, sql, folder):
    got, want = canonical(df.toPandas()), canonical(connection(folder).execute(sql).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
