"""Readers and writers. Import ``register`` to make the file formats known to a session."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    """Register the array formats. Their classes travel to the executors by value, so the
    package need not be installed there."""
    from eddyfield.sources import array_sink, arrays

    cloudpickle.register_pickle_by_value(arrays)
    cloudpickle.register_pickle_by_value(array_sink)
    spark.dataSource.register(arrays.StackSource)
    spark.dataSource.register(arrays.FrameListSource)
    spark.dataSource.register(array_sink.ArraySink)
