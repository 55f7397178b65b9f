import pytest

from fieldfold.plans import registry

from .oracle import compare

SLOW = {"sim_ideal_survey", "survey_records"}


@pytest.mark.parametrize("name", [n for n in registry.oracle_sql() if n not in SLOW])
def test_query_equals_sql(spark, sf_dir, name):
    compare(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name], sf_dir)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
