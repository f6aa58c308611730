"""Every registered query of the methylation operators against its SQL."""

import pytest

from cytolake import plans


@pytest.mark.parametrize("name", sorted(plans.oracle()))
def test_oracle(name, same):
    same(plans.queries()[name], plans.oracle()[name])


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle())))
def test_runs(name, spark, sf_dir):
    assert plans.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
