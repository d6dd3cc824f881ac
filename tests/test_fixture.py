"""The fixture holds every row of the given tables; dense tables and their reader."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from eddyfield.model import densify, read_fields, read_voxel, write_voxel
from eddyfield.plans.fixture import voxel_of
from eddyfield.session import new_path

COLUMNS = "case_id string, t int, y int, x int, u double, v double, w double, c double"


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_all_rows_arrive(spark, size):
    """The price of every order is in the mean of its voxel, the tax of every item in its sum."""
    sf_dir = f"/root/testdata/{size}"
    table = voxel_of(spark, sf_dir)
    places = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    assert table.count() == places
    got = table.agg(F.round(F.sum(F.col("w") * 16.53)).alias("tax"), F.round(F.sum((F.col("v") * 75) + 20)).alias("discount")).first()
    assert got["tax"] == items.agg(F.sum(F.round(F.col("l_tax") * 100)).alias("s")).first()["s"]
    assert got["discount"] == items.agg(F.sum(F.round(F.col("l_discount") * 100)).alias("s")).first()["s"]
    per = orders.groupBy((F.col("o_orderkey") % places).alias("p")).agg(F.avg(F.floor(F.col("o_totalprice") / 1000)).alias("m"))
    assert table.agg(F.round(F.sum(F.col("u") * 501 + 200), 3)).first()[0] == per.agg(F.round(F.sum("m"), 3)).first()[0]
    assert orders.count() > places  # the third that lies beyond the events


def test_densify(spark):
    rows = [("01", 0, 0, 1, 1.0, None, None, 2.0), ("1", 3, 1, 1, 4.0, None, None, None)]
    dense = densify(spark.createDataFrame(rows, COLUMNS), 2, 3)
    assert dense.groupBy("case_id", "t").count().collect() == [("01", 0, 6), ("1", 3, 6)] or dense.count() == 12
    assert dense.filter("u IS NOT NULL").select("case_id", "t", "y", "x", "u").orderBy("case_id").collect() == [("01", 0, 0, 1, 1.0), ("1", 3, 1, 1, 4.0)]
    outside = spark.createDataFrame([("a", 0, 2, 0, 1.0, None, None, None)], COLUMNS)
    with pytest.raises(Exception, match="outside the grid"):
        densify(outside, 2, 3).collect()


def test_case_names_stay_text(spark):
    rows = [("01", 0, 0, 0, 1.0, None, None, 2.0), ("1", 40, 0, 0, 4.0, None, None, None)]
    path = new_path(spark, "names")
    write_voxel(spark.createDataFrame(rows, COLUMNS), path)
    assert sorted(r["case_id"] for r in read_voxel(spark, path).collect()) == ["01", "1"]
    assert dict(read_fields(spark, path).dtypes)["case_id"] == "string"


def test_other_block_lengths_are_refused(spark):
    rows = [("a", 40, 0, 0, 1.0, None, None, 2.0)]
    path = new_path(spark, "blocks")
    spark.createDataFrame(rows, COLUMNS).withColumn("t_block", F.lit(0)).write.partitionBy("case_id", "t_block").parquet(path)
    with pytest.raises(ValueError, match="blocks of"):
        read_voxel(spark, path)
