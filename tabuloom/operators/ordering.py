"""Positions and running totals within a key, without gathering a key in one task.

A key is cut into runs at bounds that the data name: of the values that a key is ordered by, those whose
hash is divisible by `run_rows` are bounds. The choice depends on nothing but the values, so the plan may
compute it any number of times, and a lost executor cannot change it. A run is then ordered by a window
of its own, and what lies before it comes from the totals of the runs. Bounds and totals are one row for
every `run_rows` rows or so and are broadcast.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

RUN_ROWS = 1 << 20


def unused(columns: Sequence[str], name: str) -> str:
    """`name`, with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def running_total(frame: DataFrame, keys: Sequence[str], order: Sequence[Column], amount: Column,
                  name: str, run_rows: int = RUN_ROWS) -> DataFrame:
    """`frame` with `name`: the sum of `amount` over the rows of the key up to this one, itself included.

    `order` is ascending, nulls first; rows that tie in all of it follow each other in any order and share
    a run. Null keys are keys like any other. `amount` is a whole number.
    """
    key, place, bounds, run, before, own = (
        unused([*frame.columns, name], c) for c in ("_key", "_place", "_bounds", "_run", "_before", "_own"))
    placed = frame.withColumns({
        key: F.struct(*keys) if keys else F.struct(F.lit(0).alias("all")),
        place: F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]), own: amount})
    chosen = placed.filter(F.pmod(F.xxhash64(place), F.lit(run_rows)) == 0).groupBy(key).agg(
        F.sort_array(F.collect_set(place)).alias(bounds))
    cut = placed.join(F.broadcast(chosen), key, "left").withColumn(
        run, F.coalesce(F.size(F.filter(bounds, lambda b: b < F.col(place))), F.lit(0)))
    totals = cut.filter(F.col(bounds).isNotNull()).groupBy(key, run).agg(F.sum(own).alias(before))
    earlier = Window.partitionBy(key).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn(before, F.sum(before).over(earlier))
    within = Window.partitionBy(key, run).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.drop(bounds).withColumn(name, F.sum(own).over(within))
    return summed.join(F.broadcast(offsets), [key, run], "left").withColumn(
        name, F.col(name) + F.coalesce(before, F.lit(0))).select(*[c for c in frame.columns if c != name], name)


def position(frame: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str,
             run_rows: int = RUN_ROWS) -> DataFrame:
    """`frame` with `name`: the place of a row within its key, counted from 1; see `running_total`."""
    counted = running_total(frame, keys, order, F.lit(1), name, run_rows)
    return counted.withColumn(name, F.col(name).cast("int"))


#: Bounds that are tried for the first rows, and the rows between two of them.
FIRST_BOUNDS, FIRST_RUN = 16, 1024


def first_rows(frame: DataFrame, order: Sequence[str], n: int, run_rows: int | None = None) -> DataFrame:
    """The first `n` rows by `order` (ascending, nulls first), in order, the other columns breaking ties.

    The smallest bounds are taken, rows are counted up to each, and only those below the first bound
    that is enough are sorted: about `n` of them, not `n` of every task.  Where no bound is enough all
    rows are.
    """
    names = ("_bounds", "_run", "_enough")
    bounds, run, enough = (unused(frame.columns, c) for c in names)
    place = F.struct(*[F.col(c) for c in order])
    every = run_rows or max(n, FIRST_RUN)
    smallest = frame.select(place.alias("at")).filter(
        F.pmod(F.xxhash64("at"), F.lit(every)) == 0).distinct().orderBy("at").limit(FIRST_BOUNDS)
    found = smallest.agg(F.sort_array(F.collect_list("at")).alias("bounds"))
    cut = frame.withColumn(bounds, found.scalar()).withColumn(
        run, F.size(F.filter(bounds, lambda b: b < place)))
    counts = cut.groupBy(run).agg(F.count("*").alias("n"))
    # At most one row per bound and one more.
    so_far = counts.select(run, F.sum("n").over(Window.orderBy(run)).alias("so_far"))
    last = so_far.agg(F.coalesce(F.min(F.when(F.col("so_far") >= n, F.col(run))), F.lit(FIRST_BOUNDS)))
    rest = [c for c in frame.columns if c not in order]
    first = cut.withColumn(enough, last.scalar()).filter(F.col(run) <= F.col(enough))
    return first.orderBy(*order, *rest).limit(n).select(*frame.columns)
