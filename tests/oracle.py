"""Holds a query's rows against DuckDB's."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(root):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return con


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(round(r[i], 6) if isinstance(r[i], float) else r[i]) for i in order) for r in rows)


def differences(frame, con, sql):
    got = [tuple(r) for r in frame.collect()]
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(frame.columns)
    a, b = _rows(got, frame.columns), _rows(want.fetchall(), columns)
    return [] if a == b else [*sorted(set(a) - set(b))[:3], *sorted(set(b) - set(a))[:3], (len(a), len(b))]
