"""Every image query that SQL can express, against DuckDB on the same tables; a part of the images to be quick."""

import duckdb
import pytest

from voxelspark import queries as registered

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
#: Every other query, whatever its family, and the first of each solver; the driver's comparison has them all.
NAMES = [*dict.fromkeys([*list(registered.oracle_sql())[::2], "i3_tgv2_l1", "i9_deshade_tgv3", "i12_convergence_history", "b2_evaluate_runs"])]


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, sf_dir, db, name):
    df = registered.queries()[name](spark, sf_dir)
    sql = db.sql(registered.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(sql.columns) == cols
    order = [sql.columns.index(c) for c in cols]
    key = lambda row: tuple((v is None, v) for v in row)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    assert got == sorted((tuple(r[i] for i in order) for r in sql.fetchall()), key=key)


def test_every_sql_has_a_query():
    assert set(registered.oracle_sql()) <= set(registered.queries())
