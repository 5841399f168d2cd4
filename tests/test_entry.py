"""The driver's contract: each registered query of the engine against its SQL."""

import duckdb
import pytest

from ragspark.plans import reference_queries

SQL = reference_queries.oracle_sql()
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def value(v):
        if isinstance(v, float):
            return round(v, 9) + 0.0
        return v.isoformat() if hasattr(v, "isoformat") else v

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, sf_dir, name):
    df = reference_queries.queries()[name](spark, sf_dir)
    c = duck.execute(SQL[name])
    columns = [d[0] for d in c.description]
    assert sorted(columns) == sorted(df.columns)
    ours, theirs = plain(df.collect(), df.columns), plain(c.fetchall(), columns)
    floats = lambda rows: [tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows]
    assert sorted(floats(ours), key=repr) == sorted(floats(theirs), key=repr)


@pytest.mark.parametrize("name", sorted(set(reference_queries.queries()) - set(SQL)))
def test_without_sql_runs(spark, sf_dir, name):
    assert reference_queries.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
