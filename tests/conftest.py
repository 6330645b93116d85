import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from kinweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "kinweave-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def own_database():
    """A default DuckDB connection for each test: a result that another left unfinished would block it."""
    duckdb.set_default_connection(duckdb.connect())


@pytest.fixture
def small():
    return "/root/testdata/sf0.001"
