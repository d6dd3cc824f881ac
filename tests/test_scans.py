"""How often the voxels are read: once where once is enough."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_point

ONE_SCAN = ["turbulence_scales", "field_report", "region_report", "avg_components", "dissipation", "flow_report_field"]


@pytest.mark.parametrize("name", ONE_SCAN)
def test_one_scan(spark, name):
    plan = entry_point.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan
