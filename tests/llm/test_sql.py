import pytest

from awardry.llm.queries import ORACLE_SQL, QUERIES

from .helpers import oracle, rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert rows_of(QUERIES[name](spark, SF).toPandas()) == rows_of(oracle(SF, ORACLE_SQL[name]))
