"""Every query against its SQL counterpart on the given tables."""

import math
import os

import duckdb
import pytest

from loofold.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def sql(tables):
    con = duckdb.connect()
    for f in os.listdir(tables):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{tables}/{f}'")
    return con


def rows_of(arrow):
    names = sorted(arrow.column_names)
    columns = [arrow.column(n).to_pylist() for n in names]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    return names, sorted(zip(*columns, strict=True), key=key)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)
    return a == b


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, tables, sql, name):
    found = QUERIES[name](spark, tables).toArrow()
    if name not in ORACLES:
        assert found.num_rows > 0
        return
    wanted = sql.execute(ORACLES[name]).to_arrow_table()
    names, a = rows_of(found)
    other, b = rows_of(wanted)
    assert names == other
    assert {f.name: str(f.type) for f in found.schema} == {f.name: str(f.type) for f in wanted.schema}
    assert len(a) == len(b)
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if not all(map(same, x, y))]
    assert not wrong, wrong[:3]


def test_entry(spark, tables):
    import __spark_entry__ as driver

    assert set(driver.oracle_sql()) <= set(driver.queries())
    row = driver.queries()["loo_mcc"](spark, tables).first()
    assert (row["tp"], row["tn"], row["fp"], row["fn"], row["mcc"]) == (76, 11, 0, 0, 1.0)
