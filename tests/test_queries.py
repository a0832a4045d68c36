import pytest
from conftest import SMALL
from oracle import check

from revlake.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_against_sql(spark, name):
    check(spark, SMALL, QUERIES[name], ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__

    found = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(found) and set(QUERIES) <= set(found)
    assert __spark_entry__.entry(spark).count() > 0


def test_plans_push_down_and_join_on_keys(spark):
    plan = QUERIES["radius_pairs"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    read = QUERIES["change_summary"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "o_custkey" not in read
