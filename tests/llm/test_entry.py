import duckdb
import pytest

import __spark_entry__


def test_every_operator_is_registered_once():
    names = [q for q in __spark_entry__.queries() if q.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", [n for n in __spark_entry__.oracle_sql() if n.startswith("op")])
def test_queries_match_their_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    got = __spark_entry__.queries()[name](spark, folder)
    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(want.columns) == sorted(got.columns)
    columns = sorted(got.columns)
    rows = sorted(tuple(r) for r in got.select(*columns).collect())
    assert rows == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall())
