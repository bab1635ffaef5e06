"""Every registered query gives the rows its SQL gives in DuckDB; those without SQL run and return rows."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_DIR
from tests.oracle import compare, connect

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    if name in SQL:
        assert compare(got, con.execute(SQL[name]).df()) is None
    else:
        assert len(got) > 0


def test_entry_is_the_flagship(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "entity_key" and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)
