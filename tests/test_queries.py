"""Every registered query against its SQL, on the smallest driver tables."""

import os

import pytest

from chronolith.plans import registry

from .compare import same, tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    return tables(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, con, name):
    same(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_others_give_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert registry.FLAGSHIP in registry.queries()
