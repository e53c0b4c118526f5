import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from moneta.plans.oracle import SQL as catalog_sql
from moneta.sources.testdata import TABLES


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "n_high_risk" in df.columns


def test_oracle_keys_subset_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("key", sorted(catalog_sql))
def test_against_oracle_small(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = E.queries()[key](spark, SF_SMALL)
    res = con.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)

    def norm(cols, rows):
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        out = []
        for r in rows:
            out.append(tuple(round(r[i], 6) if isinstance(r[i], float) else str(r[i]) for i in order))
        return sorted(out, key=repr)

    assert norm(df.columns, [tuple(r) for r in df.collect()]) == norm(dcols, res.fetchall())
