"""Every registered query of the library's own against DuckDB, and the entry module without the optional subpackage."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as registered
from rankforge import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, sf_dir, name):
    got = queries.queries()[name](spark, sf_dir).toPandas()
    assert len(got)
    if name in queries.oracle_sql():
        with duckdb.connect() as db:
            for t in TABLES:
                db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
            want = db.sql(queries.oracle_sql()[name]).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        values = lambda d: sorted(map(tuple, d[columns].astype(str).values.tolist()))
        assert values(got) == values(want)


def test_entry(spark):
    assert registered.entry(spark).columns == ["query_id", "doc_id", "score", "rank"]
    assert set(registered.oracle_sql()) <= set(registered.queries())


def test_entry_without_the_subpackage(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("__spark_entry__.py", "rankforge"):
        os.symlink(f"{repo}/{name}", tmp_path / name) if name.endswith(".py") else os.mkdir(tmp_path / name)
    for name in os.listdir(f"{repo}/rankforge"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{repo}/rankforge/{name}", tmp_path / "rankforge" / name)
    code = "import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())"
    os.remove(tmp_path / "__spark_entry__.py")
    (tmp_path / "__spark_entry__.py").write_text(open(f"{repo}/__spark_entry__.py").read())
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    assert subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, check=False).returncode == 0
