"""Every query with an SQL equivalent matches it on the small tables."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from quantloom.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(str(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("blocked", ["corpus_pipeline", "quantloom.llm", "xxhash", "zstandard"])
def test_everything_else_works_without_the_subpackage(blocked):
    """Also where only a library of the subpackage is missing."""
    code = f"""
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == {blocked!r} or name.startswith({blocked!r} + "."):
            raise ImportError("blocked " + name, name=name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as entry
names = entry.queries()
assert "realized_measures_daily" in names and "feature_rows" in names
assert not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names)
assert set(entry.oracle_sql()) <= set(names)
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
