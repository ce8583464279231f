"""Every query of the core on the smallest tables: against its SQL where there is one, else that it runs."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from trialspan.plans import catalogue

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        return None if math.isnan(v) else round(float(v), 8)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, sql):
    df = catalogue.QUERIES[name](spark, str(FOLDER))
    names = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    assert len(set(names)) == len(names)
    if name in catalogue.SQL:
        result = sql.execute(catalogue.SQL[name])
        at = {d[0]: i for i, d in enumerate(result.description)}
        assert sorted(at) == names
        assert rows == sorted((tuple(plain(r[at[c]]) for c in names) for r in result.fetchall()), key=str)
