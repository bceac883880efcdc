"""Every registered query against its SQL twin."""

import pytest
from compare import difference

from docrisk.plans.catalog import CATALOG
from docrisk.plans.oracles import ORACLES


def test_every_query_has_a_twin():
    assert set(ORACLES) == set(CATALOG)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query(spark, sf_dir, con, name):
    found = difference(CATALOG[name](spark, sf_dir), con, ORACLES[name])
    assert found is None, found


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
