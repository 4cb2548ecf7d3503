"""Every registered query against its SQL in DuckDB, on the smallest tables on which its view is dense."""

import duckdb
import numpy as np
import pytest

from holdfast.plans import ORACLE, QUERIES

SIZES = {False: "/root/testdata/sf0.001", True: "/root/testdata/sf0.01"}  # voxel views have holes on the smallest
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def ducks():
    found = {}
    for dense, sf in SIZES.items():
        found[dense] = c = duckdb.connect()
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return found


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        try:
            df[c] = df[c].astype(float)
        except (TypeError, ValueError):
            df[c] = df[c].map(str)
    return df.sort_values(list(df.columns), ignore_index=True)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, ducks, name):
    dense = "fx_voxel" in ORACLE[name]
    got, want = normal(QUERIES[name](spark, SIZES[dense]).toPandas()), normal(ducks[dense].execute(ORACLE[name]).fetchdf())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype.kind == "f" and want[c].dtype.kind == "f":
            assert np.allclose(got[c], want[c], atol=2e-6, rtol=1e-9, equal_nan=True), c
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c
