import pytest
from oracle import same

import tonefield.plans.candidate_queries
import tonefield.plans.pipeline_queries
import tonefield.plans.rule_queries  # noqa: F401
from tonefield.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    same(QUERIES[name](spark, SF), duck.sql(ORACLES[name]))


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)
