"""Every query of the engine's own operators against its SQL on another engine, over the small test tables."""

import decimal
import os
import subprocess
import sys

import duckdb
import pytest

from lodestar.plans import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def value(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return str(v) if not isinstance(v, decimal.Decimal) else f"decimal {v}"


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([tuple(value(r[k]) for k in order) for r in data], key=repr)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, duck, name):
    df = q.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in q.SQL:
        assert got
        return
    result = duck.sql(q.SQL[name])
    assert sorted(df.columns) == sorted(result.columns)
    assert rows(df.columns, got) == rows(result.columns, result.fetchall())


def test_the_engine_stands_without_the_training_data_operators(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in os.listdir(repo):
        if name not in ("corpus_pipeline.py", "lodestar", ".git"):
            os.symlink(f"{repo}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "lodestar")
    for name in os.listdir(f"{repo}/lodestar"):
        if name != "llm":
            os.symlink(f"{repo}/lodestar/{name}", tmp_path / "lodestar" / name)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'bm25_search' in n and not any(k.startswith('op') and k[2].isdigit() for k in n) and 'pipeline' not in n; assert set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
