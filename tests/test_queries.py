"""Every registered query against its DuckDB statement on the smallest tables; queries without one must return rows."""

import math

import duckdb
import pytest

from rankloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Expected to be empty: invariants.
EMPTY = {"fold_leakage_zero_rows", "unique_value_per_group", "label_conflicts", "forbidden_rows_in_dev"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])

    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "~"
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(list(v)) if isinstance(v, (list, tuple)) else str(v)

    return [names[k] for k in order], sorted([value(r[k]) for k in order] for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, sf_dir, duck):
    df = catalog.queries()[name](spark, sf_dir)
    got = canonical(df.columns, df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql:
        cur = duck.execute(sql)
        assert got == canonical([d[0] for d in cur.description], cur.fetchall())
    assert got[1] or name in EMPTY


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
