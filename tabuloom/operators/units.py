"""Persons, evaluations and question bases."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from tabuloom.functions.checks import guarded
from tabuloom.operators.metrics import KEYS


def person_conflicts(facts: DataFrame, respondents: DataFrame, values: Sequence[str],
                     keys: Sequence[str] = KEYS) -> DataFrame:
    """Persons with different answers to one variable, and rows without a person.

    Uses min and max per column, not a set, so the state per person is constant.
    """
    linked = _with_person(facts, respondents)
    differs = F.lit(False)
    for name in values:
        some_null = (F.count(name) > 0) & (F.count(name) < F.count("*"))
        differs = differs | F.coalesce(F.min(name) != F.max(name), F.lit(False)) | some_null
    return linked.groupBy(*keys, "variable", "person_id").agg(
        differs.alias("different_answers"), F.count("*").alias("n_rows")
    ).select(
        *keys, "variable", "person_id",
        F.when(F.col("person_id").isNull(), "UNLINKED_ROW")
        .when(F.col("different_answers"), "DIFFERENT_ANSWERS").alias("problem"),
    ).filter(F.col("problem").isNotNull())


def varying_attributes(respondents: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Persons whose breakdown or weight column changes between evaluations."""
    checks = []
    for name in attributes:
        some_null = (F.count(name) > 0) & (F.count(name) < F.count("*"))
        varies = F.coalesce(F.min(name) != F.max(name), F.lit(False)) | some_null
        checks.append(F.when(varies, F.lit(name)))
    return respondents.groupBy("study_id", "person_id").agg(
        F.array_compact(F.array(*checks)).alias("attributes")
    ).filter(F.size("attributes") > 0)


def _with_person(facts: DataFrame, respondents: DataFrame) -> DataFrame:
    persons = respondents.select("study_id", "respondent_id", "person_id")
    return facts.join(persons, ["study_id", "respondent_id"], "left")


def to_person_unit(facts: DataFrame, respondents: DataFrame, values: Sequence[str],
                   attributes: Sequence[str] = (), keys: Sequence[str] = KEYS,
                   check: bool = True) -> tuple[DataFrame, DataFrame]:
    """Facts and respondents keyed by person.

    With `check` the facts fail to compute where answers of a person differ or a
    row has no person, and the persons where an attribute changes.  Exact
    duplicates, ignoring the weight, are dropped.
    """
    linked = _with_person(facts, respondents).drop("respondent_id").withColumnRenamed(
        "person_id", "respondent_id"
    )
    unique = linked.dropDuplicates([c for c in linked.columns if c != "weight"])
    if check:
        unique = guarded(unique, person_conflicts(facts, respondents, values, keys), F.concat(
            F.lit("question "), *[x for k in keys for x in (F.col(k).cast("string"), F.lit(" "))],
            F.lit(": "), "problem"))
    # Attributes agree within a person, so one struct minimum picks them together.
    others = [c for c in respondents.columns if c not in ("study_id", "person_id", "respondent_id")]
    persons = respondents.groupBy("study_id", "person_id").agg(
        F.min(F.struct("respondent_id", *others)).alias("__first")
    ).select(
        "study_id", F.col("person_id").alias("respondent_id"), "person_id",
        *[F.col(f"__first.{c}").alias(c) for c in others],
    )
    if check and attributes:
        persons = guarded(persons, varying_attributes(respondents, attributes), F.concat(
            F.lit("attributes change within a person: "), F.array_join("attributes", ", ")))
    return unique, persons


def question_bases(answered: Sequence[DataFrame], respondents: DataFrame, selected: DataFrame,
                   keys: Sequence[str] = KEYS) -> DataFrame:
    """Base, base before filters, persons and repeated design per question (A10).

    `answered` lists frames of (keys, respondent_id): the rows of each fact table
    that count, for grids only those with a valid base.
    """
    ids = None
    for frame in answered:
        part = frame.select(*keys, "respondent_id").distinct()
        ids = part if ids is None else ids.unionByName(part)
    ids = ids.distinct()
    flags = respondents.select("study_id", "respondent_id", "person_id").join(
        selected.select("study_id", "respondent_id").withColumn("is_selected", F.lit(1)),
        ["study_id", "respondent_id"], "left",
    )
    joined = ids.join(flags, ["study_id", "respondent_id"])
    persons = joined.groupBy(*keys, "person_id").agg(
        F.count("*").alias("n_all"), F.count("is_selected").alias("n_selected")
    )
    design = respondents.groupBy("study_id", "person_id").count().groupBy("study_id").agg(
        (F.max("count") > 1).alias("repeated_design")
    )
    return persons.groupBy(*keys).agg(
        F.sum("n_selected").alias("base"),
        F.sum("n_all").alias("base_before_filters"),
        F.count_if(F.col("n_selected") > 0).alias("person_base"),
        (F.max("n_selected") > 1).alias("repeated_people"),
    ).join(design, "study_id").withColumn(
        "base_unit", F.when(F.col("repeated_design"), "Evaluaciones").otherwise("Respondentes")
    )
