import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from orrery.session import local_session
    from orrery.shipping import ship

    s = local_session(4, "tests", "6g")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    ship(s)
    yield s
    s.stop()


DATA = "/root/testdata/sf0.001"
DATA_1 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def duck():
    """Runs SQL over the tables of a scale."""
    import duckdb

    def run(sql: str, d: str = DATA):
        con = duckdb.connect()
        con.sql("SET TimeZone = 'UTC'")
        for p in os.listdir(d):
            con.sql(f"CREATE VIEW {p.removesuffix('.parquet')} AS SELECT * FROM '{d}/{p}'")
        return con.sql(sql).df()

    return run


@pytest.fixture(scope="session")
def same_rows():
    def check(a, b):
        cols = sorted(a.columns)
        assert cols == sorted(b.columns)
        key = lambda df: sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))
        assert key(a) == key(b)

    return check
