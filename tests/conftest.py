"""One session and the smallest tables for all tests."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from quillon.session import local_session

    s = local_session(4, 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """A query's rows against its SQL's."""

    def value(v):
        return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)

    def check(frame, sql):
        columns = sorted(frame.columns)
        rows = sorted(tuple(value(r[c]) for c in columns) for r in frame.collect())
        made = duck.execute(sql)
        names = [x[0] for x in made.description]
        assert sorted(names) == columns
        places = [names.index(c) for c in columns]
        assert rows == sorted(tuple(value(r[k]) for k in places) for r in made.fetchall())
        return len(rows)

    return check
