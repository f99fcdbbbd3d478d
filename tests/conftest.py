import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from suite.check import session

    return session()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture
def one(spark):
    """Rows of a frame as dicts keyed by one column."""

    def read(df, key="column"):
        return {r[key]: r.asDict(recursive=True) for r in df.collect()}

    return read
