"""Every query of the engine against its SQL, on the smallest tables."""

import os

import pytest

from cohortlab import queries as engine

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Need strata with all four cells, which the smallest tables lack.
LARGER = {"stratified_mantel_haenszel": "/root/testdata/sf0.01", "fourfold_estimates": "/root/testdata/sf0.01"}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def rows(frame):
    def show(v):
        if v is None or v != v:
            return ""
        try:
            return f"{float(v) + 0.0:.5f}".replace("-0.00000", "0.00000")
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(show(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_query(spark, name):
    import duckdb

    folder = LARGER.get(name, DATA)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    mine, theirs = engine.queries()[name](spark, folder).toPandas(), db.execute(engine.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(engine.queries()) - set(engine.oracle_sql())))
def test_runs(spark, name):
    assert engine.queries()[name](spark, DATA).count() >= 0
