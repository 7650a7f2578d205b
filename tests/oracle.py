"""Compare a query with its SQL in DuckDB, as multisets of rows."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame):
    df = df[sorted(df.columns)]
    return sorted((tuple(None if pd.isna(x) else float(x) if isinstance(x, float) else x.item() if hasattr(x, "item") else x for x in r) for r in df.itertuples(index=False)), key=repr)


def same(spark, con, sf_dir, query, sql):
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b), (len(a), len(b))
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not bad, bad[:2]
