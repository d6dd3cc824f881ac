"""The engine's tables derived from the given star-schema tables.

One voxel per event on a sensor of 10 rows and 20 columns: the event value is the scalar. Orders
are dealt to the voxels by their number, round after round, until none is left: their mean price
gives u, their line items give v and w. Two cases take turns frame by frame. Values are whole
numbers, or means of a few, over a constant; samples below the sensor floor are masked. Frames that
the events do not fill are filled up with missing samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyfield.model import densify, read_voxel, write_voxel
from eddyfield.session import new_path, settle

# Fixed values of the fixture, shared by the Spark and the SQL form.
ROWS, COLUMNS, CASES = 10, 20, 2
X_PITCH, Y_PITCH = 0.7, -0.6
X_ORIGIN, X_CASE_SHIFT, Y_ORIGIN = -6.65, 0.1, 4.2

_tables: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _tables:
        _tables[key] = build()
    return _tables[key]


def voxel_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The voxel table as a plan over the given tables. Every event, order and line item is in it."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    places = events.count()
    per_order = items.groupBy((F.col("l_orderkey") % places).alias("place")).agg(
        F.sum(F.round(F.col("l_discount") * 100)).alias("v"), F.sum(F.round(F.col("l_tax") * 100)).alias("w")
    )
    prices = orders.groupBy((F.col("o_orderkey") % places).alias("at")).agg(F.avg(F.floor(F.col("o_totalprice") / 1000)).alias("price"))
    frame = F.floor(F.col("event_id") / (ROWS * COLUMNS))
    sampled = (
        events.join(prices, events.event_id == prices["at"], "left")
        .join(per_order, events.event_id == per_order["place"], "left")
        .select(
            F.concat(F.lit("case"), (frame % CASES).cast("string")).alias("case_id"),
            F.floor(F.col("event_id") / (ROWS * COLUMNS * CASES)).cast("int").alias("t"),
            (F.floor(F.col("event_id") / COLUMNS) % ROWS).cast("int").alias("y"),
            (F.col("event_id") % COLUMNS).cast("int").alias("x"),
            ((F.col("price") - 200) / 501.0).alias("u"),
            ((F.col("v") - 20) / 75.0).alias("v"),
            (F.col("w") / 16.53).alias("w"),
            F.when(F.col("value") >= 0.5, F.floor("value") / 255.0).alias("c"),
        )
    )
    return densify(sampled, ROWS, COLUMNS)


VOXEL_SQL = """
sampled AS (
  SELECT 'case' || CAST((e.event_id // 200) % 2 AS VARCHAR) AS case_id,
         CAST(e.event_id // 400 AS INTEGER) AS t,
         CAST((e.event_id // 20) % 10 AS INTEGER) AS y,
         CAST(e.event_id % 20 AS INTEGER) AS x,
         (o.price - 200) / 501.0::DOUBLE AS u,
         (l.v - 20) / 75.0::DOUBLE AS v,
         l.w / 16.53::DOUBLE AS w,
         CASE WHEN e.value >= 0.5 THEN floor(e.value) / 255.0::DOUBLE END AS c
  FROM events e
  LEFT JOIN (SELECT o_orderkey % (SELECT count(*) FROM events) AS place, avg(floor(o_totalprice / 1000)) AS price FROM orders GROUP BY ALL) o ON o.place = e.event_id
  LEFT JOIN (SELECT l_orderkey % (SELECT count(*) FROM events) AS place, sum(round(l_discount * 100)) AS v, sum(round(l_tax * 100)) AS w
             FROM lineitem GROUP BY ALL) l ON l.place = e.event_id
),
voxel AS MATERIALIZED (
  SELECT f.case_id, f.t, CAST(ys.i AS INTEGER) AS y, CAST(xs.i AS INTEGER) AS x, s.u, s.v, s.w, s.c
  FROM (SELECT DISTINCT case_id, t FROM sampled) f CROSS JOIN range(10) ys(i) CROSS JOIN range(20) xs(i)
  LEFT JOIN sampled s ON s.case_id = f.case_id AND s.t = f.t AND s.y = ys.i AND s.x = xs.i
)"""


def voxel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The voxel table, stored once per session in the engine's layout."""

    def build() -> DataFrame:
        path = new_path(spark, "voxel")
        write_voxel(voxel_of(spark, sf_dir), path)
        return read_voxel(spark, path)

    return _once(spark, sf_dir, "voxel", build)


def axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates of the pixels: x ascending and shifted per case, y descending."""

    def build() -> DataFrame:
        pixels = voxel(spark, sf_dir).select("case_id", "y", "x").distinct()
        shift = F.substring("case_id", 5, 9).cast("double") * F.lit(X_CASE_SHIFT)
        columns = pixels.select(
            "case_id",
            F.lit("x").alias("dim"),
            F.col("x").alias("idx"),
            (F.lit(X_ORIGIN) + shift + F.lit(X_PITCH) * F.col("x")).alias("mm"),
        )
        rows = pixels.select(
            "case_id", F.lit("y").alias("dim"), F.col("y").alias("idx"), (F.lit(Y_ORIGIN) + F.lit(Y_PITCH) * F.col("y")).alias("mm")
        )
        return settle(columns.unionByName(rows).distinct(), "axis")

    return _once(spark, sf_dir, "axis", build)


AXIS_SQL = """
axis AS MATERIALIZED (
  SELECT DISTINCT case_id, 'x' AS dim, x AS idx,
         -6.65::DOUBLE + CAST(substr(case_id, 5) AS DOUBLE) * 0.1::DOUBLE + 0.7::DOUBLE * x AS mm FROM voxel
  UNION ALL
  SELECT DISTINCT case_id, 'y' AS dim, y AS idx, 4.2::DOUBLE + -0.6::DOUBLE * y AS mm FROM voxel
)"""
