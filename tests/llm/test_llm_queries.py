import oracle
import pytest
from conftest import SF

from panelmill.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    assert oracle.difference(QUERIES[name](spark, SF), con, ORACLE[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_repeats_itself(spark, name):
    a, b = (sorted(map(str, QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert a and a == b
