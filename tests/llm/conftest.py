import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """The awkward documents as a DataFrame with extra columns whose names clash with working columns."""
    return spark.createDataFrame(brute.awkward(), brute.COLUMNS).repartition(5).persist()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], brute.COLUMNS)


@pytest.fixture(scope="session")
def known(spark):
    """Labels of the awkward documents, some missing."""
    rows = [(100 + i, i % 2, (i + 1) % 2) for i in range(30)] + [(3, 1, 0), (None, 1, 1), (6, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
