import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from featherloom.session import BROADCAST_ROWS, GROUP_ROWS, get_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", 8, 8)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def large_paths(spark):
    """Limits so low that every group counts as too large for one task and every table as too large to broadcast."""
    spark.conf.set(GROUP_ROWS[0], "3")
    spark.conf.set(BROADCAST_ROWS[0], "1")
    yield spark
    spark.conf.unset(GROUP_ROWS[0])
    spark.conf.unset(BROADCAST_ROWS[0])


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)
