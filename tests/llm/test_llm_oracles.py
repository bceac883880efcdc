"""Queries of the text operators against their SQL twins."""

import pytest
from compare import difference

from docrisk.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf_dir, con, name):
    found = difference(QUERIES[name](spark, sf_dir), con, ORACLES[name])
    assert found is None, found


def test_registration():
    import __spark_entry__ as entry

    numbers = [int(name[2:].split("_")[0]) for name in entry.queries() if name.startswith("op")]
    assert sorted(numbers) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
