import pytest

from tests.oracle import DATA, agree
from trailmetric import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    agree(spark, plans.QUERIES[name], plans.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    frame = plans.QUERIES[name](spark, DATA)
    assert frame.count() > 0 and len(set(frame.columns)) == len(frame.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
