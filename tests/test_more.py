"""Every further query gives its SQL's rows at the smallest scale."""

import pytest

from strandlake.plans.more import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLES[name])
