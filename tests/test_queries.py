"""Every core query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import decimal
from pathlib import Path

import duckdb
import pytest

from tabulon import queries as core

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = core.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    found = duck.sql(core.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()]
    got = [tuple(plain(x) for x in r) for r in df.select(*cols).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_visual_lines_with_ties(spark):
    """At sf0.1 thousands of orders have equal boxes: the SQL leaves none of them to chance."""
    big = DATA.parent / "sf0.1"
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from read_parquet('{big}/lineitem.parquet')")
    cols = ["l_orderkey", "line", "n_boxes", "x0", "top", "x1", "bottom"]
    want = con.execute(f"select {', '.join(cols)} from ({core.oracle_sql()['visual_lines']})").fetchall()
    got = [tuple(r) for r in core.queries()["visual_lines"](spark, str(big)).select(*cols).toPandas().itertuples(index=False, name=None)]
    assert sorted(got) == sorted(want)
