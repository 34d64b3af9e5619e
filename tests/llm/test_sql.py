"""The queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from rankforge.llm import queries


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    if name == "op7_secret_scan":
        sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # the smallest documents hold no secret
    got = queries.queries()[name](spark, sf_dir).toPandas()
    with duckdb.connect() as db:
        for t in ("documents", "embeddings"):
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        want = db.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    values = lambda d: sorted(map(tuple, d[columns].astype(str).values.tolist()))
    assert values(got) == values(want) and len(got)
