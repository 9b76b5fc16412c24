"""Every query of the catalogue that has SQL gives the SQL's rows at the smallest scale."""

import pytest

from strandlake.plans.catalog import QUERIES
from strandlake.plans.oracles import ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(name, spark):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").limit(5).count() > 0
