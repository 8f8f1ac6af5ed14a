"""Paired comparisons of the same persons."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabuloom.functions.checks import fails
from tabuloom.functions.pvalues import (
    binomial_half_two_sided, student_quantile, student_two_sided,
)
from tabuloom.operators.metrics import ratio


class PairingError(ValueError):
    """Sides that cannot be compared pair by pair."""


def condition_side(facts: DataFrame, respondents: DataFrame, value: str, condition: Column,
                   by: Sequence[str] = ("study_id",)) -> DataFrame:
    """Rows of one condition reduced to a person: mean, number of rows."""
    people = respondents.filter(condition).select("study_id", "respondent_id", "person_id")
    rows = facts.join(people, ["study_id", "respondent_id"]).filter(F.col(value).isNotNull())
    return rows.groupBy(*by, "person_id").agg(
        F.avg(value).alias("value"), F.count("*").alias("n_rows")
    )


def overlap(respondents: DataFrame, left: Column, right: Column) -> DataFrame:
    """Evaluations that would stand on both sides."""
    return respondents.filter(left & right).select("study_id", "respondent_id")


def person_pairs(left: DataFrame, right: DataFrame, by: Sequence[str] = ("study_id",)) -> DataFrame:
    """Full outer join on the person; a complete pair has both values."""
    a = left.select(*by, "person_id", F.col("value").alias("a"), F.col("n_rows").alias("rows_a"))
    b = right.select(*by, "person_id", F.col("value").alias("b"), F.col("n_rows").alias("rows_b"))
    return a.join(b, [*by, "person_id"], "full_outer")


def _counts() -> list[Column]:
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return [
        F.count("a").alias("persons_a"), F.count("b").alias("persons_b"),
        F.coalesce(F.sum("rows_a"), F.lit(0)).alias("rows_a"),
        F.coalesce(F.sum("rows_b"), F.lit(0)).alias("rows_b"),
        F.count_if(F.col("rows_a") > 1).alias("repeated_a"),
        F.count_if(F.col("rows_b") > 1).alias("repeated_b"),
        F.count_if(both).alias("pairs"),
        F.avg(F.when(both, F.col("a"))).alias("mean_a"),
        F.avg(F.when(both, F.col("b"))).alias("mean_b"),
    ]


def _reject_repeats(stats: DataFrame) -> DataFrame:
    """Fails, when computed, where a person has several evaluations in one condition."""
    repeats = F.col("repeated_a") + F.col("repeated_b") > 0
    return stats.filter(F.when(
        repeats, fails("a person has several evaluations in one condition")).otherwise(True))


def paired_means(pairs: DataFrame, by: Sequence[str] = ("study_id",), confidence: float = 0.95,
                 min_pairs: int = 30, duplicates: str = "reject",
                 with_p: bool = True) -> DataFrame:
    """Paired t on person means.

    `duplicates='person_mean'` accepts several evaluations of a person in one
    condition; 'reject' raises.
    """
    if duplicates not in ("reject", "person_mean"):
        raise ValueError("duplicates must be 'reject' or 'person_mean'")
    d = F.col("a") - F.col("b")
    stats = pairs.groupBy(*by).agg(*_counts(), F.stddev_samp(d).alias("sd_difference"))
    if duplicates == "reject":
        stats = _reject_repeats(stats)
    n, sd = F.col("pairs"), F.col("sd_difference")
    stats = stats.withColumns({
        "without_pair_a": F.col("persons_a") - n, "without_pair_b": F.col("persons_b") - n,
        "difference": F.col("mean_a") - F.col("mean_b"),
    }).withColumn("t", ratio(F.col("difference"), sd / F.sqrt(n)))
    if not with_p:
        return stats
    enough = n >= min_pairs
    effect = F.col("difference")
    margin = student_quantile(F.lit((1 + confidence) / 2), (n - 1).cast("double")) * sd / F.sqrt(n)
    p = F.when(sd == 0, F.when(effect == 0, 1.0).otherwise(0.0)).otherwise(
        student_two_sided(F.col("t"), (n - 1).cast("double"))
    )
    tested = stats.withColumns({
        "ci_low": F.when(enough, F.when(sd == 0, effect).otherwise(effect - margin)),
        "ci_high": F.when(enough, F.when(sd == 0, effect).otherwise(effect + margin)),
        "p_value": F.when(enough, p),
    })
    return tested.withColumn("result", _verdict(enough, confidence))


def paired_proportions(pairs: DataFrame, by: Sequence[str] = ("study_id",),
                       confidence: float = 0.95, min_pairs: int = 30,
                       with_p: bool = True, check: bool = True) -> DataFrame:
    """Exact McNemar on two 0/1 conditions (Z7).  There is no interval."""
    stats = pairs.groupBy(*by).agg(
        *_counts(),
        F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("yes_no"),
        F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("no_yes"),
    )
    if check:
        stats = _reject_repeats(stats)
    n = F.col("pairs")
    enough = n >= min_pairs
    stats = stats.withColumns({
        "without_pair_a": F.col("persons_a") - n, "without_pair_b": F.col("persons_b") - n,
        "difference": F.col("mean_a") - F.col("mean_b"),
        "yes_no": F.when(enough, F.col("yes_no")), "no_yes": F.when(enough, F.col("no_yes")),
    })
    if not with_p:
        return stats
    discordant = (F.col("yes_no") + F.col("no_yes")).cast("double")
    tested = stats.withColumn("p_value", F.when(enough, binomial_half_two_sided(
        F.coalesce(F.col("yes_no").cast("double"), F.lit(0.0)),
        F.coalesce(discordant, F.lit(0.0)),
    )))
    return tested.withColumn("result", _verdict(enough, confidence))


def _verdict(enough: Column, confidence: float) -> Column:
    return (
        F.when(~enough, "Base insuficiente")
        .when(F.col("p_value") < 1 - confidence, "Diferencia significativa")
        .otherwise("Sin diferencia significativa")
    )


def selection_facts(base: DataFrame, mentions: DataFrame, code: object,
                    keys: Sequence[str] = ("study_id", "question_id")) -> DataFrame:
    """0/1 per respondent of an explicit base: was the option chosen?"""
    chosen = mentions.filter(F.col("code").try_cast("double") == float(code)).select(
        *keys, "respondent_id"
    ).distinct().withColumn("chosen", F.lit(1))
    return base.join(chosen, [*keys, "respondent_id"], "left").select(
        *keys, "respondent_id", F.coalesce("chosen", F.lit(0)).alias("value")
    )
