import os

import pytest

SF = "/root/testdata/sf0.001"


def names():
    from tallyscope.queries import QUERIES

    return sorted(QUERIES)


def test_every_core_query_has_a_twin():
    from tallyscope.queries import QUERIES, SQL

    assert set(QUERIES) == set(SQL)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", names())
def test_query_equals_its_twin(spark, name):
    import duckdb

    from tallyscope.queries import QUERIES, SQL

    db = duckdb.connect()
    for file in os.listdir(SF):
        db.sql(f"create view {file.removesuffix('.parquet')} as select * from '{SF}/{file}'")
    got = QUERIES[name](spark, SF)
    twin = db.sql(SQL[name])
    columns = sorted(got.columns)
    assert sorted(twin.columns) == columns
    places = [twin.columns.index(c) for c in columns]
    want = sorted(repr(tuple(row[i] for i in places)) for row in twin.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == want
