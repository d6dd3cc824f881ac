"""Every registered query against its SQL form on the two smallest sets of tables."""

from __future__ import annotations

import pytest
from compare import differences, oracle_connection

import __spark_entry__ as entry_point
from eddyfield.plans import catalog

SIZES = ["sf0.001", "sf0.01"]


@pytest.fixture(scope="module", params=SIZES)
def given(request):
    sf_dir = f"/root/testdata/{request.param}"
    return sf_dir, oracle_connection(sf_dir)


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert set(catalog.queries()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, given, name):
    sf_dir, connection = given
    assert differences(catalog.queries()[name](spark, sf_dir), connection, catalog.oracle_sql()[name]) == []


def test_entry(spark):
    assert entry_point.entry(spark).count() == 400
