import duckdb
import pytest

import __spark_entry__ as entry
from lyceum.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(rows):
    def cell(v):
        return None if v is None or v != v else round(v, 6) if isinstance(v, float) else v

    return sorted((tuple(map(cell, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    result = sql.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = [tuple(r[names.index(c)] for c in columns) for r in result.fetchall()]
    assert plain(df.select(*columns).collect()) == plain(expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_streaming(spark, tmp_path):
    from lyceum.streaming.landing import follow

    spark.range(5).write.parquet(f"{tmp_path}/in")
    seen = []
    follow(spark, f"{tmp_path}/in", "id long", f"{tmp_path}/cp", lambda df, k: seen.append(df.count())).awaitTermination()
    assert sum(seen) == 5
