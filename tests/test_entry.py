"""Driver contract: entry(), queries(), oracle_sql() agree with DuckDB."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import TABLES, digest  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_entry_runs_and_has_rows(spark):
    df = E.entry(spark)
    assert df.columns == ["cik", "fiscal_year", "revenue", "prior_revenue", "yoy_growth"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    """The library's own queries; those of the optional part have SQL where SQL
    can express them and are tested against brute force there."""
    own = {**E.analysis_queries(), **E.operator_queries()}
    assert set(own) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


def test_a_missing_dependency_leaves_the_library_queries():
    """One that only the optional subpackage needs; in a process of its own."""
    import subprocess
    import sys

    code = ("import sys, warnings; sys.modules['sentencepiece'] = None; sys.modules['tokenizers'] = None\n"
            "warnings.simplefilter('error'); warnings.filterwarnings('ignore', message='the training-data queries')\n"
            "import __spark_entry__ as E; print(len(E.queries()), any(q.startswith('op1_') or q == 'pipeline' for q in E.queries()))")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[-2]) >= 56 and out[-1] == "False"
