"""Queries of the subpackage against their SQL, over the small tables."""

from __future__ import annotations

import pytest
from compare import differences, oracle_connection

import __spark_entry__ as entry_point
import corpus_pipeline
from eddyfield.llm import registry

SIZES = ["sf0.001", "sf0.01"]


@pytest.fixture(scope="module", params=SIZES)
def given(request):
    sf_dir = f"/root/testdata/{request.param}"
    return sf_dir, oracle_connection(sf_dir)


def test_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14))
    assert set(registry.QUERIES) <= set(entry_point.queries())
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, given, name):
    sf_dir, connection = given
    assert differences(registry.QUERIES[name](spark, sf_dir), connection, registry.ORACLES[name]) == []
