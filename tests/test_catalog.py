"""Every query against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tessera.plans import catalog

SF = Path("/root/testdata/sf0.001")
TABLES = ["documents", "embeddings", "pages", "conversations", "nation", "region"]

pytestmark = pytest.mark.skipif(not SF.exists(), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", catalog.queries())
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, str(SF)).toPandas()
    expected = duck.sql(catalog.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    rows = [sorted(map(str, df[columns].itertuples(index=False, name=None))) for df in (got, expected)]
    assert len(rows[0]) == len(rows[1])
    assert [tuple(map(str, r)) for r in sorted(got[columns].astype(str).itertuples(index=False, name=None))] == [
        tuple(map(str, r)) for r in sorted(expected[columns].astype(str).itertuples(index=False, name=None))
    ]


def test_entry_point_has_every_query(spark):
    import __spark_entry__

    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 10
