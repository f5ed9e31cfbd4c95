import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from sliceweave.session import local_session

    session = local_session(8, shuffle_partitions=4, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def hot(spark):
    """Groups above 40 rows count as hot, so the split plans run on small data."""
    from sliceweave.session import HOT_ROWS_CONF

    spark.conf.set(HOT_ROWS_CONF, "40")
    yield
    spark.conf.unset(HOT_ROWS_CONF)
