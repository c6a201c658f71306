"""Turning arrays into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(
    rows: DataFrame, keep: list[str], array: str | Column, name: str, position: str | None = None
) -> DataFrame:
    """One row per non-null element of ``array``, beside the ``keep`` columns.

    A plain ``explode`` makes Spark infer the filter "array is not empty" and
    push it to the scan, which computes a costly array twice or more. The outer
    form does not, and dropping its empty rows afterwards gives the same rows.
    """
    if position is None:
        exploded = rows.select(*keep, F.explode_outer(array).alias(name))
    else:
        exploded = rows.select(*keep, F.posexplode_outer(array).alias(position, name))
    return exploded.where(F.col(name).isNotNull())


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed only once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
