from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

from corrmail.plans.queries import oracle_sql, queries

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
NAMES = sorted(oracle_sql())


def cells(rows):
    def norm(x):
        return str(round(x, 6)) if isinstance(x, float) else str(x)

    return sorted(tuple(map(norm, r)) for r in rows)


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in DATA.glob("*.parquet"):
        con.sql(f"create view {table.stem} as select * from '{table}'")
    df = queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = cells(tuple(r) for r in df.select(*columns).collect())
    expected = con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({oracle_sql()[name]})").fetchall()
    assert got == cells(expected)
