import pytest

from candlewright.plans import registry

from oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_its_sql(spark, name):
    compare(spark, SF, registry.queries()[name], registry.oracle_sql()[name])
