"""Field statistics of plume measurements as Spark DataFrame operators."""

__version__ = "0.1.0"
