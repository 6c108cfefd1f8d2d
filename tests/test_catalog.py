"""Every query that has SQL gives the rows that DuckDB does."""

import duckdb
import pytest

import __spark_entry__
from kinweave.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return "None" if v is None else repr(float(v)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_against_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = db.execute(catalog.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns and columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


def test_queries_without_sql_are_few():
    """Each of these is tested in test_models.py, by plain code or by recall."""
    assert set(catalog.QUERIES) - set(catalog.SQL) == {"block_dense_compressed", "block_dense_ivf", "block_phonetic", "features_all", "metaphone_codes", "model_scores", "normalised_records"}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
