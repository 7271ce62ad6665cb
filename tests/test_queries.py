"""Every query with SQL against DuckDB, on the smallest tables."""

import duckdb
import pytest

from thalweg.plans.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


def plain(v):
    if v is None or str(v) in ("NaT", "<NA>", "nan"):
        return "null"
    if hasattr(v, "year"):
        return str(v)[:10]
    if isinstance(v, bool):
        return str(v)
    try:
        return f"{float(v):.3f}".replace("-0.000", "0.000")
    except (TypeError, ValueError):
        return str(v)


def rows(pdf):
    return sorted(tuple(plain(r[c]) for c in sorted(pdf.columns)) for r in pdf.to_dict("records"))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
