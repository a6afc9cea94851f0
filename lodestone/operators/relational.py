"""The relational operators in DataFrame form. Each is declarative: Catalyst picks the physical plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Join kinds; cross with a condition is an inner join.
JOIN_KINDS = {"inner": "inner", "left": "left", "right": "right", "cross": "cross"}


def _column(e: Column | str) -> Column:
    return F.expr(e) if isinstance(e, str) else e


def scan(spark: SparkSession, table: str, alias: str | None = None) -> DataFrame:
    """All rows of a registered table, under its alias if one is given."""
    frame = spark.table(table)
    return frame.alias(alias) if alias else frame


def filter_rows(frame: DataFrame, predicate: Column | str) -> DataFrame:
    """Rows for which the predicate is true (not false, not null)."""
    return frame.where(predicate)


def project(frame: DataFrame, expressions: Sequence[Column | str]) -> DataFrame:
    """Only the listed expressions. Text may carry an alias (``a + 1 AS b``), ``*`` or ``t.*``."""
    return frame.selectExpr(*expressions) if all(isinstance(e, str) for e in expressions) else frame.select(*map(_column, expressions))


def join(left: DataFrame, right: DataFrame, condition: Column | str | None = None, kind: str = "inner") -> DataFrame:
    """Combine two inputs on any condition. The whole condition stays in ON, which outer joins need."""
    how = JOIN_KINDS[kind]
    if condition is None:
        if kind != "cross":
            raise ValueError(f"{kind} join needs a condition")
        return left.crossJoin(right)
    return left.join(right, _column(condition), "inner" if how == "cross" else how)


def aggregate(frame: DataFrame, keys: Sequence[Column | str], aggregates: Sequence[Column | str]) -> DataFrame:
    """GROUP BY keys with aggregates; no keys: one row; no aggregates: distinct keys."""
    keys, aggregates = [*map(_column, keys)], [*map(_column, aggregates)]
    if not aggregates:
        return frame.select(*keys).distinct()
    return frame.groupBy(*keys).agg(*aggregates) if keys else frame.agg(*aggregates)


def having(frame: DataFrame, keys: Sequence[Column | str], aggregates: Sequence[Column | str], predicate: Column | str) -> DataFrame:
    """Aggregate, keep groups for which the predicate over an aggregate is true; it may use aggregates that aren't returned."""
    shown = aggregate(frame, keys, [*aggregates, _column(predicate).alias("__having")])
    return shown.where("__having").drop("__having")


def sort(frame: DataFrame, keys: Sequence[Column | str]) -> DataFrame:
    """Total order over the keys; text may end in ASC or DESC."""
    out = []
    for key in keys:
        if isinstance(key, str):
            name, _, way = key.strip().rpartition(" ")
            key = F.expr(name).desc() if way.upper() == "DESC" else F.expr(name).asc() if way.upper() == "ASC" else F.expr(key).asc()
        out.append(key)
    return frame.orderBy(*out)


def limit(frame: DataFrame, count: int) -> DataFrame:
    """At most ``count`` rows; after a sort Spark fuses both into a top-k."""
    if count < 0:
        raise ValueError("a limit can't be negative")
    return frame.limit(count)
