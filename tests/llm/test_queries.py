"""The registered queries of the subpackage against their SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from deltaloom.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(queries.oracle_sql()[name])
    names = sorted(c[0] for c in want.description)
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == names
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    rows = want.df().astype(object)
    rows = rows.where(rows.notna(), None)[names].itertuples(index=False, name=None)
    number = lambda v: int(v) if isinstance(v, float) and v.is_integer() else plain(v)  # noqa: E731, ids with nulls come as floats
    assert sorted(str([number(v) for v in r]) for r in got.select(*names).toPandas().astype(object).where(lambda x: x.notna(), None).itertuples(index=False, name=None)) == sorted(str([number(v) for v in r]) for r in rows)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
