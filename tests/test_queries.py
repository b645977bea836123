import glob
import os
import subprocess
import sys

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CHEAP = ["extent", "first_n_per_group", "random_subset", "canvas_normalise", "hit_test", "pca", "grp", "knn_exact", "upsert_run"]


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) >= 100


def test_registry_needs_no_session():
    code = "import __spark_entry__ as e; from planisphere.plans import all_queries, all_sql; assert all_queries().keys() == all_sql().keys() and set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries()[name](spark, SF)
    cur = con.execute(oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(map(repr, cur.fetchall()))
    assert sorted(repr(tuple(r[n] for n in names)) for r in df.collect()) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_entry(spark):
    df = entry(spark)
    assert df.count() == 50 and df.filter("NOT all_unique").isEmpty()
