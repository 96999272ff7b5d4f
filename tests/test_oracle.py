"""Every query that has SQL gives the SQL's rows."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from sparkpulse.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if isinstance(v, float) and v == v:
            return f"{v:.6g}"
        return "NULL" if v is None or pd.isna(v) is True else str(v)

    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.execute(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, small).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry_reads_rows(spark):
    assert entry.entry(spark).count() > 0


def test_all_queries_are_registered():
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
