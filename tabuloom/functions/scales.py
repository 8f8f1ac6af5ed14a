"""Boxes and promoter groups of one scale value."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tabuloom.constants import DETRACTOR, PASSIVE, PROMOTER


def top2box(value: Column, low: Column, high: Column) -> Column:
    """1 in the two highest points; a 1-5 scale tests membership, so 4.5 is 0."""
    five_points = (low == 1) & (high == 5)
    hit = F.when(five_points, value.isin(4, 5)).otherwise(value >= high - 1)
    return F.coalesce(hit, F.lit(False)).cast("int")


def bottom2box(value: Column, low: Column, high: Column) -> Column:
    five_points = (low == 1) & (high == 5)
    hit = F.when(five_points, value.isin(1, 2)).otherwise(value <= low + 1)
    return F.coalesce(hit, F.lit(False)).cast("int")


def nps_group(value: Column) -> Column:
    """0-6, exactly 7 or 8, exactly 9 or 10; anything else is ''."""
    return (
        F.when(value.between(0, 6), DETRACTOR)
        .when(value.isin(7, 8), PASSIVE)
        .when(value.isin(9, 10), PROMOTER)
        .otherwise("")
    )
