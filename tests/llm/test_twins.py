"""The registered queries against their SQL twins."""

import pytest

from oracle import connect, difference
from stocklens.llm.oracles import LLM_SQL
from stocklens.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(LLM_SQL))
def test_query_equals_its_twin(spark, name):
    result = difference(LLM_QUERIES[name](spark, SF), connect(SF), LLM_SQL[name])
    assert result is None, result
