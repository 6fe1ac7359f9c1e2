import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from simweave.session import local_session

    session = local_session("tests", cpus=4, memory="4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables():
    """DuckDB with the small tables as views."""
    import duckdb

    con = duckdb.connect()
    for name in sorted(os.listdir(SMALL)):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SMALL}/{name}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    return value


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def same_as_sql(spark, tables):
    """Compares a query on the small tables with its SQL."""

    def check(query, sql):
        df = query(spark, SMALL)
        cursor = tables.execute(sql)
        columns = [c[0] for c in cursor.description]
        assert sorted(df.columns) == sorted(columns)
        assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cursor.fetchall(), columns)

    return check
