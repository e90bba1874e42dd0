"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from riverbend.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows(frame):
    """Rows in an order that exact columns decide before rounded numbers do."""
    frame = frame[sorted(frame.columns)].astype(object)
    plain = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)
    out = [tuple(plain(v) for v in r) for r in frame.itertuples(index=False)]
    key = lambda r: [("", "") if v is None else ("n", f"{v:020.4f}") if isinstance(v, float) else ("s", v) for v in r]
    exact = lambda r: [k for k, v in zip(key(r), r, strict=True) if not isinstance(v, float) or np.isfinite(v) and v == int(v)]
    return sorted(out, key=lambda r: (exact(r), key(r)))


@pytest.mark.parametrize("name", sorted(n for n in catalog.ORACLE if not n.endswith("_stream")))
def test_query(spark, sf_dir, duck, name):
    got, expected = catalog.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert len(got) == len(expected)
    for a, b in zip(rows(got), rows(expected), strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == (pytest.approx(y, rel=1e-4, abs=1e-4) if isinstance(y, float) else y), (a, b)
