"""Every query runs and, where it has SQL, equals DuckDB's result on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from arborist.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the tables aren't here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"create view {f.stem} as from '{f}'")
    return con


def lines(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(str([str(round(x, 6) + 0.0) if isinstance(x, float) else str(x) for x in r]) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    q = catalogue.QUERIES[name]
    got = q.run(spark, str(DATA)).toPandas()
    if q.sql:
        assert lines(got) == lines(duck.sql(q.sql).df())
    else:
        assert len(got)
