"""Compare a query with its SQL on DuckDB, as the driver does."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return bool(x)
    if hasattr(x, "isoformat"):
        return x.isoformat()[:10] if x.isoformat()[10:] in ("", "T00:00:00") else x.isoformat()
    try:
        return round(float(x), 4) + 0.0
    except (TypeError, ValueError):
        return str(x)


def rows(frame_rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(([_plain(r[k]) for k in order] for r in frame_rows), key=repr)


def same(spark_df, con, sql):
    rel = con.sql(sql)
    assert sorted(spark_df.columns) == sorted(rel.columns)
    left, right = rows([tuple(r) for r in spark_df.collect()], spark_df.columns), rows(rel.fetchall(), rel.columns)
    assert len(left) == len(right)
    assert left == right
