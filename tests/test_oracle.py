"""Every query against its SQL equivalent in another engine."""

import duckdb
import pytest
from helpers import rows

from keyspan.plans.oracle import all_oracle_sql
from keyspan.plans.queries import all_queries

DIR = "/root/testdata/sf0.01"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW events AS SELECT * FROM '{DIR}/events.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_oracle_sql())


@pytest.mark.parametrize("name", all_queries())
def test_query(spark, database, name):
    found = all_queries()[name](spark, DIR)
    result = database.execute(all_oracle_sql()[name])
    types = {column[0]: str(column[1]) for column in result.description}
    assert {column: TYPES[kind] for column, kind in found.dtypes} == types
    columns = sorted(types)
    order = [list(types).index(column) for column in columns]
    want = sorted((tuple(row[i] for i in order) for row in result.fetchall()), key=repr)
    assert rows(found, *columns) == want
    assert want
