import re

import pytest

from tests.compare import connect, difference
from workload.oracles import ORACLES
from workload.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    if name not in ORACLES:
        assert QUERIES[name](spark, SF_DIR).columns
        return
    assert difference(spark, con, QUERIES[name], ORACLES[name], SF_DIR) is None


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


UNSHUFFLED = [
    "category_shares", "window_usage", "largest_messages", "large_tool_results", "duplicate_content", "base64_blobs",
    "long_histories", "cache_orderings", "window_pressure", "ranked_findings", "conversation_profiles", "profile_headlines",
]


@pytest.mark.parametrize("name", UNSHUFFLED)
def test_texts_are_not_shuffled(spark, name, monkeypatch):
    """Small tables are dealt over the cores first; without that no text crosses a shuffle or sort."""
    staged = []
    monkeypatch.setattr("workload.inputs.SMALL_BYTES", 0)
    monkeypatch.setattr("workload.queries.stage", lambda rows, _: staged.append(rows) or rows)
    crossed = set()
    for rows in [QUERIES[name](spark, SF_DIR), *staged]:
        plan = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
        for inputs in re.findall(r"\(\d+\) (?:Exchange|Sort)\b[^\n]*\nInput \[\d+\]: \[([^\]]*)\]", plan):
            crossed |= {column.split("#")[0].strip() for column in inputs.split(",")}
    assert crossed and not crossed & {"text", "opt_text"}
