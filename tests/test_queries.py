"""Every registered query against its DuckDB SQL, to six digits."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from siltstone import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return ""
        if isinstance(v, float):
            return f"{v + 0.0:.6f}"
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in df.astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.SQL:
        assert len(got) >= 1
        return
    want = duck.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:  # whole numbers become doubles in pandas where nulls are
        if pd.api.types.is_float_dtype(got[c]) != pd.api.types.is_float_dtype(want[c]) and (got[c].isna().any() or want[c].isna().any()):
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert plain(got) == plain(want)
