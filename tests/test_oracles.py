import pytest

from lotlens.plans import registry

from .oracle import differences

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_twin(spark, name):
    assert differences(registry.QUERIES[name](spark, SMALL), registry.ORACLE_SQL[name], SMALL) == []


def test_every_query_has_a_twin():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)
