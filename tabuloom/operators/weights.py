"""Weighted bases and weight diagnostics."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabuloom.functions.text import column_type, is_numeric_type
from tabuloom.operators.metrics import ratio
from tabuloom.operators.ordering import RUN_ROWS, running_total

DISTRIBUTION_POINTS = (0.01, 0.05, 0.5, 0.95, 0.99)


def _weight_parts(df: DataFrame, weight: str) -> dict[str, Column]:
    """Classify one raw weight.  Text is non-numeric even when it looks like a number."""
    dtype, col = column_type(df, weight), F.col(weight)
    if not is_numeric_type(dtype):
        absent = col.isNull()
        return {"missing": absent, "non_numeric": ~absent, "non_finite": F.lit(False),
                "value": F.lit(None).cast("double")}
    value = col.cast("double")
    absent, infinite = col.isNull(), F.lit(False)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        absent = absent | F.isnan(col)
        infinite = ~absent & (F.abs(value) == float("inf"))
    return {"missing": absent, "non_numeric": F.lit(False), "non_finite": infinite,
            "value": F.when(~absent & ~infinite, value)}


def _classified(eligible: DataFrame, weight: str, keys: Sequence[str]) -> DataFrame:
    """One row per respondent, then the class of its weight."""
    unique = eligible.groupBy(*keys, "respondent_id").agg(
        F.min(weight).alias("__w")
    )
    parts = _weight_parts(unique, "__w")
    value = parts["value"]
    return unique.select(
        *keys,
        parts["missing"].alias("missing"), parts["non_numeric"].alias("non_numeric"),
        parts["non_finite"].alias("non_finite"),
        F.coalesce(value < 0, F.lit(False)).alias("negative"),
        F.when(value >= 0, value).alias("w"),
    )


def weighted_base(eligible: DataFrame, weight: str, keys: Sequence[str] = ("study_id",),
                  significance_requested: bool = False) -> DataFrame:
    """Unweighted, weighted and effective (Kish) n with a status.

    Missing and non-numeric weights are left out with a warning; negative or
    non-finite weights and a total of 0 or less fail; zero is allowed.  Nothing
    is normalised or trimmed.
    """
    counts = _classified(eligible, weight, keys).groupBy(*keys).agg(
        F.count("*").alias("unweighted_n"),
        F.count("w").alias("valid_n"),
        *[F.count_if(c).alias(f"{c}_n")
          for c in ("missing", "non_numeric", "non_finite", "negative")],
        F.count_if(F.col("w") == 0).alias("zero_n"),
        F.coalesce(F.sum("w"), F.lit(0.0)).alias("total"),
        F.coalesce(F.sum(F.col("w") * F.col("w")), F.lit(0.0)).alias("squares"),
    )
    bad_values = (F.col("non_finite_n") > 0) | (F.col("negative_n") > 0)
    no_mass = (F.col("unweighted_n") > 0) & (F.col("total") <= 0)
    failed = bad_values | no_mass
    warned = (F.col("missing_n") > 0) | (F.col("non_numeric_n") > 0)
    if significance_requested:
        warned = F.lit(True)
    rates = [ratio(F.col(f"{c}_n"), F.col("unweighted_n")).alias(f"{c}_rate")
             for c in ("missing", "non_numeric", "non_finite", "negative", "zero")]
    return counts.select(
        *keys, "unweighted_n", "valid_n", "missing_n", "non_numeric_n", "non_finite_n",
        "negative_n", "zero_n", *rates,
        F.when(~failed, F.col("total")).alias("weighted_n"),
        F.when(~bad_values & (F.col("total") > 0), ratio(
            F.col("total") * F.col("total"), F.col("squares")
        )).alias("effective_n"),
        F.when(failed, "FAIL").when(warned, "PASS_WITH_WARNINGS").otherwise("PASS")
        .alias("status"),
        F.lit("UNSUPPORTED" if significance_requested else "NOT_TESTED")
        .alias("significance_status"),
    )


def weight_distribution(eligible: DataFrame, weight: str, keys: Sequence[str] = ("study_id",),
                        run_rows: int = RUN_ROWS) -> DataFrame:
    """Extremes, interpolated percentiles, cv and ratio of valid weights.

    Percentiles are picked by rank: equal weights are counted, the counts are
    added up along the sorted weights of a study (in runs, see `ordering`), and
    the weights on both sides of each rank are taken.  No task or buffer holds
    the weights of a study.
    """
    valid = _classified(eligible, weight, keys).filter(F.col("w").isNotNull()).select(*keys, "w")
    stats = valid.groupBy(*keys).agg(
        F.count("*").alias("valid_n"),
        F.min("w").alias("minimum"), F.max("w").alias("maximum"), F.avg("w").alias("mean"),
        F.stddev_pop("w").alias("sd"),
        F.min(F.when(F.col("w") > 0, F.col("w"))).alias("smallest_positive"),
    )
    counts = valid.groupBy(*keys, "w").agg(F.count("*").alias("same"))
    ranked = running_total(counts, keys, [F.col("w")], F.col("same"), "upto", run_rows)
    sized = ranked.join(stats.select(*keys, "valid_n"), list(keys))
    names = ("p1", "p5", "median", "p95", "p99")
    ranks = {name: (F.col("valid_n") - 1) * F.lit(p) for name, p in zip(names, DISTRIBUTION_POINTS)}

    def at(rank: Column) -> Column:
        """Ranks count from 0; a weight takes those from upto - same to upto - 1."""
        return F.max(F.when((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("same")), F.col("w")))

    def between(name: str) -> Column:
        low, high, rank = F.col(f"{name}_low"), F.col(f"{name}_high"), ranks[name]
        return F.when(low == high, low).otherwise(
            (F.ceil(rank) - rank) * low + (rank - F.floor(rank)) * high)

    picked = sized.groupBy(*keys).agg(*[
        at(side(rank)).alias(f"{name}_{end}")
        for name, rank in ranks.items() for end, side in (("low", F.floor), ("high", F.ceil))])
    return stats.join(picked, list(keys)).select(
        *keys, "minimum", *[between(name).alias(name) for name in names],
        "mean", "maximum",
        ratio(F.col("sd"), F.col("mean")).alias("cv"),
        ratio(F.col("maximum"), F.col("smallest_positive")).alias("max_min_positive_ratio"),
    )
