"""Rules on data that stay part of the plan: they run with the result, not before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def fails(message: str | Column) -> Column:
    """A condition that never holds: a row on which it is evaluated ends the query."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.raise_error(text).cast("boolean")


def guarded(frame: DataFrame, problems: DataFrame, message: str | Column) -> DataFrame:
    """`frame`, which fails when it is computed if `problems` has a row.

    `message` may use the columns of `problems`.
    """
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in frame.schema.fields]
    return frame.unionByName(problems.filter(fails(message)).select(*none))
