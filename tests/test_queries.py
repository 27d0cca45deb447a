"""Every query of the engine on the smallest tables: against its SQL where it has one."""

import math

import duckdb
import pytest

from plumbline.plans import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def key(row):
    return tuple((x is not None, str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    assert name in ORACLES, "a query without SQL needs a test of its own"
    r = db.execute(ORACLES[name])
    names, types = [x[0] for x in r.description], {x[0]: str(x[1]) for x in r.description}
    assert sorted(names) == cols
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    want = sorted((tuple(row[names.index(c)] for c in cols) for row in r.fetchall()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and (math.isclose(x, y, rel_tol=1e-12) or x != x and y != y)) for x, y in zip(a, b)), (a, b)


def test_plans_have_no_cartesian_product_and_prune_columns(spark):
    for name in ("area_by_type", "classify_traces", "nearest_wall", "project_scale", "late_results"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
    plan = QUERIES["area_by_type"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "l_shipdate" not in plan and "p_name" not in plan


def test_entry_runs_without_the_training_data_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    out = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op1_') for n in e.queries()), 'pipeline' in e.queries())"], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})
    assert out.stdout.split()[1:] == ["False", "False"], out.stderr
