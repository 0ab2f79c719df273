import pytest

from scrubline.llm import queries
from tests.compare import DATA, same_rows


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, DATA), queries.ORACLES[name])
