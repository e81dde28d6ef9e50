"""Every core query against the SQL that states the same result, over whole tables."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb
import pytest

from pagemill.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return f"{float(v):.9g}" if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, engine, name):
    rows = catalog.queries()[name](spark, SF)
    names = sorted(rows.columns)
    got = Counter(str([plain(r[c]) for c in names]) for r in rows.collect())
    want = engine.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == names
    places = [want.columns.index(c) for c in names]
    assert got == Counter(str([plain(r[i]) for i in places]) for r in want.fetchall())


def test_queries_without_sql_are_few():
    assert len(set(catalog.queries()) - set(catalog.oracle_sql())) <= 0.3 * len(catalog.queries())
