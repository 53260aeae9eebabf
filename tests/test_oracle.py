"""Every registered query against its DuckDB twin at sf0.01 (the driver's correctness gate),
rows-only queries for a non-empty stable schema, and the flagship entry."""

import pytest

import __spark_entry__ as E
from oracle import compare, duck

SF = "/root/testdata/sf0.01"
QUERIES = E.queries()
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_sql_key_is_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_twin(spark, con, name):
    problems = compare(spark, con, name, QUERIES[name], SQL[name], SF)
    assert not problems, problems


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only_query_runs(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    schema = df.schema
    assert df.count() > 0
    assert QUERIES[name](spark, "/root/testdata/sf0.001").schema == schema


def test_entry(spark):
    rows = E.entry(spark).collect()
    assert {r["phase"] for r in rows} == {"train", "val"}
    assert all(r["n_examples"] >= 0 and r["n_steps"] >= 0 for r in rows)


def test_outputs_are_flat_and_named(spark):
    allowed_time = {("object_catalog", "mtime")}
    for name, fn in QUERIES.items():
        sch = fn(spark, "/root/testdata/sf0.001").schema
        names = [f.name for f in sch.fields]
        assert len(set(names)) == len(names), name
        for f in sch.fields:
            t = f.dataType.simpleString()
            assert not t.startswith(("array", "map", "struct", "binary")), (name, f.name, t)
            if t.startswith("timestamp"):
                assert (name, f.name) in allowed_time
