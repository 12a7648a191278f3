import pytest

from context_shaper.llm.queries import ORACLES, QUERIES
from tests.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert difference(spark, connect(SF_DIR), QUERIES[name], ORACLES[name], SF_DIR) is None


def test_there_is_a_query_for_each_operator():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
