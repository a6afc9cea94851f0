"""Aggregates whose results don't depend on the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_sum(c: Column, scale: int = 2) -> Column:
    """Sum of a double in decimal arithmetic: any order of summation gives the same double."""
    return F.sum(c.cast(f"decimal(18,{scale})")).cast("double")


def exact_avg(c: Column, scale: int = 2) -> Column:
    """Mean as an exact sum over the count of non-null values."""
    return exact_sum(c, scale) / F.count(c)
