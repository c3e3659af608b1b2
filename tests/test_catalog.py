"""Every registered query against its SQL twin on the smallest tables."""

import math
import os

import duckdb
import pytest

from lexmill.plans import catalog


def plain(v):
    if v is None:
        return ""
    return f"{v:.6g}" if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf}/{t}'")
    return con


@pytest.fixture(scope="module")
def oracle(sf):
    return catalog.oracle(sf)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf, duck, oracle, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in oracle:
        assert got
        return
    rel = duck.execute(oracle[name])
    names = [d[0] for d in rel.description]
    want = sorted(tuple(plain(v) for _, v in sorted(zip(names, row))) for row in rel.fetchall())
    assert cols == sorted(names) and got == want


BOOLEAN = [n for n in catalog.QUERIES if n.startswith("bool_")]


@pytest.mark.parametrize("name", BOOLEAN)
def test_boolean_queries_on_more_rows(spark, name):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("test tables are absent")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    df = catalog.QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = con.execute(catalog.oracle(folder)[name])
    names = [x[0] for x in rel.description]
    assert got == sorted(tuple(plain(v) for _, v in sorted(zip(names, row))) for row in rel.fetchall())


def test_searches_read_the_terms_they_need(spark, sf, capsys):
    catalog.QUERIES["bool_and"](spark, sf).explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [In(term" in plan and "Generate" not in plan
    catalog.QUERIES["term_lookup"](spark, sf).explain("formatted")
    assert "EqualTo(term" in capsys.readouterr().out


def test_flagship(spark, sf):
    assert catalog.flagship(spark, sf).count() > 0


def test_no_row_at_a_time_python(spark, sf, capsys):
    for name in catalog.QUERIES:
        catalog.QUERIES[name](spark, sf).explain("formatted")
        plan = capsys.readouterr().out
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan and "CartesianProduct" not in plan, name
