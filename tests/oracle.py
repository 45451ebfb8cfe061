"""A query's rows against those of its SQL on the same Parquet tables."""

import os

import duckdb
import numpy as np
import pandas as pd

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[str]:
    def plain(x):
        if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
            return None
        if isinstance(x, (bool, np.bool_)):
            return bool(x)
        if isinstance(x, str) or hasattr(x, "__len__"):
            return x
        return round(float(x), 5) + 0.0

    return sorted(repr([plain(x) for x in r]) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


def same(spark, con, query, sql) -> None:
    got, want = query(spark, SF_DIR).toPandas(), con.execute(sql).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
