"""Compare a DataFrame with what DuckDB returns for SQL over the same Parquet tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, int) and not isinstance(x, bool):
        return float(x)
    return x if x is None or isinstance(x, (bool, str)) else str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


def differences(df, con, sql):
    """Up to five rows that only one side has; empty if both agree."""
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    ours, theirs = rows(df.columns, df.collect()), rows(names, found.fetchall())
    if sorted(df.columns) != sorted(names):
        return [("columns", sorted(df.columns), sorted(names))]
    if ours == theirs:
        return []
    from collections import Counter

    a, b = Counter(ours), Counter(theirs)
    return [("ours", r) for r in list((a - b).elements())[:3]] + [("theirs", r) for r in list((b - a).elements())[:3]] + [(len(ours), len(theirs))]
