"""Missing values. NULL is the only missing marker inside the engine.

Two rules are needed. *Skip* leaves missing samples out of a statistic: that is what
Spark's aggregates do. *Strict* makes a statistic missing as soon as one sample is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(value: Column) -> Column:
    """NaN and infinities become NULL. Apply once, when data enters."""
    value = value.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def complete(*values: Column) -> Column:
    """Aggregate predicate: no row of the group lacks any of ``values``."""
    present = values[0].isNotNull()
    for value in values[1:]:
        present = present & value.isNotNull()
    return F.count(F.when(present, 1)) == F.count(F.lit(1))


def strict(statistic: Column, *values: Column) -> Column:
    """``statistic`` when no row lacks ``values``, else NULL."""
    return F.when(complete(*values), statistic)


def floor_at(value: Column, low: Column | float) -> Column:
    """Raise ``value`` to ``low``; missing stays missing (``greatest`` would skip it)."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(low) if not isinstance(low, Column) else low))
