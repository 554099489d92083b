"""Each registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from relspark import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = core.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in core.SQL:
        want = duck.sql(core.SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert got == rows(want.columns, want.fetchall())


def test_keys_of_many_rows_are_numbered_whole(spark, tmp_path):
    n = 25_000
    spark.range(n).selectExpr("3L as conv_id", "int(id) as turn", "'user' as role", "'' as text").write.parquet(f"{tmp_path}/conversations.parquet")
    some = spark.read.parquet(f"{SF}/orders.parquet").limit(1).drop("o_orderkey", "o_custkey", "o_orderdate")
    kinds = dict(spark.read.parquet(f"{SF}/orders.parquet").dtypes)
    keys = spark.range(n).selectExpr(f"cast(id as {kinds['o_orderkey']}) as o_orderkey", f"cast(10 as {kinds['o_custkey']}) as o_custkey", f"cast(timestamp '1996-01-01' + make_interval(0, 0, 0, int(id % 900)) as {kinds['o_orderdate']}) as o_orderdate")
    keys.crossJoin(some).write.parquet(f"{tmp_path}/orders.parquet")
    got = core.QUERIES["find_by_prefix"](spark, str(tmp_path)).collect()
    assert sorted(r.rn for r in got) == list(range(1, n + 1)) and all(r.rn == r.turn + 1 for r in got)
    got = sorted(core.QUERIES["list_by_secondary_descending"](spark, str(tmp_path)).collect(), key=lambda r: r.rn)
    assert [r.rn for r in got] == list(range(1, n + 1))
    assert got == sorted(got, key=lambda r: (r.o_orderdate, r.o_orderkey), reverse=True)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
