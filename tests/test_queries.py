"""Every registered query against its reference SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from extracteval.plans.registry import QUERIES as CORE
from tools.check_oracle import TABLES, rows_of

# the queries of optional subpackages have tests of their own
QUERIES = {k: v for k, v in entry.queries().items() if k in CORE}
ORACLES = {k: v for k, v in entry.oracle_sql().items() if k in CORE}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_reference(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rel = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())


def test_every_surveyed_operator_is_registered():
    expected = (
        [f"s{i}" for i in range(1, 12)] + [f"p{i}" for i in range(1, 24)] + [f"f{i}" for i in range(1, 7)]
        + [f"j{i}" for i in range(1, 15)] + [f"u{i}" for i in range(1, 7)] + [f"a{i}" for i in range(1, 36)]
        + [f"w{i}" for i in range(1, 9)] + [f"k{i}" for i in range(1, 6)] + [f"r{i}" for i in range(1, 7)]
        + [f"x{i}" for i in range(1, 14)] + [f"t{i}" for i in range(1, 16)] + ["i1", "i2", "i3"]
    )
    have = {n.split("_")[0] for n in QUERIES}
    assert [e for e in expected if e not in have] == []
    # only the manifest of the input files themselves has no SQL form; that of files made from texts has
    assert sorted(set(QUERIES) - set(ORACLES)) == ["s8_manifest"]


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row["queries"] == 200 and row["queries_all_keys"] == 0
