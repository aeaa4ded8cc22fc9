"""Every registered query with SQL against that SQL."""

import pytest

from reviewlane.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", ORACLES)
def test_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLES[name])
