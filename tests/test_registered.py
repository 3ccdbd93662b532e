"""Every registered query against its DuckDB text at the smallest scale."""

import pytest
from comparing import QUERIES, difference, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, connection, name):
    assert difference(spark, connection, FOLDER, name) is None
