"""Text operators that SQL can express, against DuckDB over whole tables."""

import pytest
from check_oracle import compare, duck

from lineforge.llm.oracles import ORACLES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    same, message = compare(spark, duck(FOLDER), FOLDER, name)
    assert same, message
