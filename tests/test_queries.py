"""Every query against DuckDB on the same tables."""

import duckdb
import pytest

from relatum.plans import queries as q

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def settled(rows):
    def cell(v):
        return round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else v

    return sorted((tuple(map(cell, r)) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_same_rows_as_sql(spark, data, duck, name):
    got = q.QUERIES[name](spark, data)
    names = sorted(got.columns)
    want = duck.execute(q.ORACLE_SQL[name])
    kinds = {d[0]: str(d[1]) for d in want.description}
    assert sorted(kinds) == names
    assert {c: TYPES.get(t) for c, t in got.dtypes} == kinds
    order = [[d[0] for d in want.description].index(c) for c in names]
    assert settled([tuple(r[c] for c in names) for r in got.collect()]) == settled([tuple(r[i] for i in order) for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLE_SQL)))
def test_runs(spark, data, name):
    assert q.QUERIES[name](spark, data).columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_optional_parts(tmp_path):
    """Imports with the subpackage and the pipeline taken away."""
    import os
    import shutil
    import subprocess
    import sys

    from tests.conftest import ROOT

    shutil.copytree(f"{ROOT}/relatum", tmp_path / "relatum", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 90; assert not any(k.startswith('op1_') or k == 'pipeline' for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
