"""NULL-skipping value-at-extreme-time aggregates.

``first_by(x, t)`` is the value of ``x`` on the earliest row where both ``x``
and ``t`` are present; ``last_by`` the latest. Rows where ``x`` is NULL are
skipped, so each attribute is chosen independently. Ties on ``t`` are broken
by the value itself (smallest for first, largest for last), which makes the
result independent of row order. The aggregate is the min/max of a
``(t, x)`` struct: associative, so Spark runs it map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _keyed(value: Column, order: Column, where: Column | None) -> Column:
    cond = value.isNotNull() & order.isNotNull()
    if where is not None:
        cond = cond & where
    return F.when(cond, F.struct(order.alias("t"), value.alias("v")))


def first_by(value: Column, order: Column, where: Column | None = None) -> Column:
    return F.min(_keyed(value, order, where)).getField("v")


def last_by(value: Column, order: Column, where: Column | None = None) -> Column:
    return F.max(_keyed(value, order, where)).getField("v")
