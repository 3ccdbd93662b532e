"""Registered queries of the subpackage against their DuckDB text."""

import pytest
from comparing import duck, kinds, rows

from pageloom.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLE)
def test_query(spark, name):
    mine, other = QUERIES[name](spark, FOLDER).toPandas(), duck(FOLDER).execute(ORACLE[name]).df()
    assert kinds(mine) == kinds(other) and len(mine) > 0
    assert rows(mine) == rows(other)
